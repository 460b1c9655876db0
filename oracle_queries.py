"""The registered queries in DuckDB's SQL, written on their own to check the results."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Common table expressions, by name, with the names that each one needs.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (sql, needs)


def with_parts(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in PARTS[name][1]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n][0]})" for n in order) + "\n" + select


def oracle(name: str, select: str, *needs: str) -> None:
    ORACLES[name] = with_parts(select, *needs)


part("ev", """
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         event_id // 4 AS tick,
         'c' || CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id // 15 + 1 END AS cluster, 'w' || (user_id // 3 % 5) AS worker
  FROM events""")
part("points", """
  SELECT event_type AS measurement, ts AS time, 'runner-' || (user_id % 5) AS host,
         'exp-' || (user_id % 3) AS experiment_name, value, CAST(k AS DOUBLE) AS k, event_id
  FROM ev""", "ev")

STAMP = "'%Y-%m-%d %H:%M:%S'"


def bucket(width: str, column: str = "time") -> str:
    return f"time_bucket(INTERVAL '{width}', {column})"


# --- reports -----------------------------------------------------------------------------

oracle("report_window_mean", f"""
  SELECT host, experiment_name, measurement, strftime({bucket('5 minutes')}, {STAMP}) AS window_start,
         round(avg(value), 6) AS mean
  FROM points GROUP BY 1, 2, 3, 4 HAVING avg(value) IS NOT NULL AND avg(value) <> 0""", "points")
part("long_points", """
  SELECT host, experiment_name, measurement, time, 'value' AS metric, value AS v FROM points
  UNION ALL SELECT host, experiment_name, measurement, time, 'k', k FROM points""", "points")
oracle("report_mean_of_means", f"""
  SELECT host, experiment_name, measurement, metric, round(avg(m), 6) AS mean, count(*) AS windows
  FROM (SELECT host, experiment_name, measurement, metric, {bucket('1 hour')} AS w, avg(v) AS m
        FROM long_points GROUP BY ALL) WHERE m <> 0 GROUP BY ALL""", "long_points")
oracle("report_max_min_count", """
  SELECT host, experiment_name, measurement, metric, max(v) AS max, min(v) AS min, count(v) AS count
  FROM long_points GROUP BY ALL""", "long_points")

part("report_fields", """
  SELECT host, experiment_name, time, 'resources' AS kind, unnest([
    {'metric': 'cpu', 'v': value}, {'metric': 'mem', 'v': k},
    {'metric': 'download', 'v': CASE WHEN k % 2 = 0 THEN value END},
    {'metric': 'upload', 'v': CASE WHEN k % 3 = 0 THEN 0 ELSE k END}]) AS f
  FROM points WHERE measurement = 'view'
  UNION ALL
  SELECT host, experiment_name, time, 'predictions', unnest([
    {'metric': 'actual_cpu', 'v': value}, {'metric': 'actual_mem', 'v': k},
    {'metric': 'predicted_cpu', 'v': CASE WHEN k % 5 <> 0 THEN value + 1 END},
    {'metric': 'predicted_mem', 'v': k + 1}])
  FROM points WHERE measurement = 'click'
  UNION ALL
  SELECT host, experiment_name, time, 'accuracy', unnest([
    {'metric': 'acc_cpu', 'v': value / 2}, {'metric': 'acc_mem', 'v': 100 - k}])
  FROM points WHERE measurement = 'purchase'
  UNION ALL
  SELECT host, experiment_name, time, 'latency', {'metric': 'data_collection_latency', 'v': k}
  FROM points WHERE measurement = 'purchase'
  UNION ALL
  SELECT host, experiment_name, time, 'latency', {'metric': 'prediction_latency', 'v': value}
  FROM points WHERE measurement = 'signup'
  UNION ALL
  SELECT host, experiment_name, time, 'latency',
    {'metric': CASE WHEN k % 2 = 0 THEN 'ml_model_update_latency' ELSE 'anomaly_detection_latency' END, 'v': value}
  FROM points WHERE measurement = 'error'""", "points")


def full_report(width: str) -> str:
    return f"""
  SELECT host, experiment_name, section, metric, window_start, round(value, 6) AS value FROM (
    SELECT host, experiment_name, kind, metric, strftime(w, {STAMP}) AS window_start, m AS value,
           CASE kind WHEN 'resources' THEN 'average_resources' WHEN 'predictions' THEN 'average_predictions'
                ELSE kind END AS section
    FROM means
    UNION ALL
    SELECT host, experiment_name, kind, metric, NULL, avg(m),
           CASE kind WHEN 'resources' THEN 'average_resources' WHEN 'predictions' THEN 'average_predictions'
                ELSE kind END
    FROM means GROUP BY host, experiment_name, kind, metric
    UNION ALL
    SELECT host, experiment_name, kind, f.metric, NULL, max(f.v), 'max'
    FROM report_fields WHERE kind = 'resources' GROUP BY ALL HAVING max(f.v) IS NOT NULL
    UNION ALL
    SELECT host, experiment_name, kind, f.metric, NULL, min(f.v), 'min'
    FROM report_fields WHERE kind = 'resources' GROUP BY ALL HAVING max(f.v) IS NOT NULL
    UNION ALL
    SELECT host, experiment_name, kind, f.metric, NULL, count(f.v), 'frequency'
    FROM report_fields WHERE f.metric IN ('predicted_cpu', 'predicted_mem') GROUP BY ALL)"""


for _width, _name in (("1 hour", "report_full"), ("6 hours", "report_files")):
    part("means", f"""
  SELECT host, experiment_name, kind, f.metric AS metric, {bucket(_width)} AS w, avg(f.v) AS m
  FROM report_fields GROUP BY ALL HAVING avg(f.v) <> 0""", "report_fields")
    oracle(_name, full_report(_width), "means")

_report = ORACLES["report_files"]
_at = _report.rindex("SELECT host, experiment_name, section")
ORACLES["report_lines"] = _report[:_at].rstrip() + f""", report AS ({_report[_at:]})
  SELECT host, experiment_name, section, metric, window_start,
         CASE WHEN section IN ('max', 'min') THEN upper(section[1]) || section[2:] || ' ' || metric || ' for ' || split_part(host, '-', 2)
                || ': ' || printf('%.5f', value)
              WHEN section = 'frequency' THEN 'Number of ' || replace(metric, 'predicted_', '') || ' predictions for '
                || split_part(host, '-', 2) || ': ' || CAST(value AS BIGINT)
              WHEN window_start IS NOT NULL THEN strftime(CAST(window_start AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto', {STAMP})
                || ': ' || printf('%.5f', value)
              ELSE 'mean: ' || printf('%.5f', value) END AS line
  FROM report"""
for _metric, _column in (("k", "k"), ("latency", "value / 1000.0::DOUBLE")):
    part(f"six_hours_{_metric}", f"""
  SELECT host, experiment_name, {bucket('6 hours')} AS w, avg({_column}) AS m FROM points
  GROUP BY ALL HAVING avg({_column}) <> 0""", "points")
oracle("report_call", f"""
  SELECT host, experiment_name, 'max' AS op, 'value' AS metric, CAST(NULL AS VARCHAR) AS window_start, round(max(value), 6) AS value
  FROM points GROUP BY ALL
  UNION ALL SELECT host, experiment_name, 'min', 'value', NULL, round(min(value), 6) FROM points GROUP BY ALL
  UNION ALL SELECT host, experiment_name, 'freq', 'k', NULL, CAST(count(k) AS DOUBLE) FROM points GROUP BY ALL
  UNION ALL SELECT host, experiment_name, 'avg', 'k', strftime(w, {STAMP}), round(m, 6) FROM six_hours_k
  UNION ALL SELECT host, experiment_name, 'avg', 'k', NULL, round(avg(m), 6) FROM six_hours_k GROUP BY ALL
  UNION ALL SELECT host, experiment_name, 'latency', 'step_latency', strftime(w, {STAMP}), round(m, 6) FROM six_hours_latency
  UNION ALL SELECT host, experiment_name, 'latency', 'step_latency', NULL, round(avg(m), 6) FROM six_hours_latency GROUP BY ALL""",
       "six_hours_k", "six_hours_latency")
oracle("step_latency", f"""
  SELECT host, experiment_name, measurement || '_latency' AS measurement, strftime({bucket('1 hour')}, {STAMP}) AS window_start,
         round(avg(CAST(round(value * 1000) AS BIGINT) / 1e6::DOUBLE), 9) AS mean
  FROM points GROUP BY 1, 2, 3, 4 HAVING avg(value) <> 0""", "points")
oracle("local_time", f"""
  SELECT measurement, strftime(w, '%Y-%m-%dT%H:%M:%SZ') AS utc,
         strftime(w AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto', {STAMP}) AS local
  FROM (SELECT measurement, {bucket('1 hour')} AS w, avg(value) AS m FROM points GROUP BY ALL) WHERE m <> 0""", "points")
oracle("formatted_output", """
  SELECT event_id, host, printf('%.2f', value / 8) AS places2, printf('%.3f', value / 8) AS places3,
         printf('%.5f', value / 8) AS places5 FROM points""", "points")

# --- samples, snapshots, phases ---------------------------------------------------------

part("raw_samples", """
  SELECT cluster, worker, tick, event_id, event_type, k,
         CASE WHEN event_id % 17 = 0 THEN c || ','
              WHEN event_id % 19 = 0 THEN c || ',abc'
              WHEN event_id % 23 = 0 THEN c || ',' || k || ',9'
              WHEN event_id % 29 = 0 THEN ''
              ELSE c || ',' || k END AS line
  FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS c FROM ev)""", "ev")
part("run_functions", """
  SELECT cluster, worker, tick, list_sort(list_distinct(list(' ' || event_type || '.step' || i || ' *** ' || (k % 4) || chr(10)))) AS funcs
  FROM raw_samples, range(1, 13) steps(i) WHERE tick % 7 <> 0 GROUP BY ALL""", "raw_samples")
part("samples", """
  SELECT cluster, worker, tick, resource_data, coalesce(funcs, []) AS threaddump_data
  FROM (SELECT cluster, worker, tick, arg_max(line, event_id) AS resource_data FROM raw_samples GROUP BY ALL)
  LEFT JOIN run_functions USING (cluster, worker, tick)""", "raw_samples", "run_functions")
part("workers", "SELECT DISTINCT cluster, worker FROM ev", "ev")
part("missing", """
  SELECT t.cluster, t.tick, w.worker FROM (SELECT DISTINCT cluster, tick FROM samples) t JOIN workers w USING (cluster)
  WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.cluster = t.cluster AND s.tick = t.tick AND s.worker = w.worker)""",
     "samples", "workers")


def field(i: int) -> str:
    return (
        f"CASE WHEN len(string_split(resource_data, ',')) = 2 "
        f"THEN try_cast(nullif(trim(string_split(resource_data, ',')[{i}]), '') AS DOUBLE) END"
    )


part("parsed", f"SELECT cluster, worker, tick, resource_data, {field(1)} AS cpu, {field(2)} AS mem FROM samples", "samples")
part("all_parsed", """
  SELECT cluster, worker, tick, cpu, mem FROM parsed
  UNION ALL SELECT cluster, worker, tick, 0.0, 0.0 FROM missing""", "parsed", "missing")


def fill(source: str) -> str:
    over = "OVER (PARTITION BY cluster, worker ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last = [f"coalesce({r}, last_value({r} IGNORE NULLS) {over}, 0.0) AS {r}" for r in ("cpu", "mem")]
    return f"SELECT cluster, worker, tick, {', '.join(last)} FROM {source}"


part("filled", fill("all_parsed"), "all_parsed")
part("present_filled", fill("parsed"), "parsed")
part("sizes", "SELECT cluster, count(*) AS n FROM workers GROUP BY ALL", "workers")
MEANS = "cluster, tick, round(sum(cpu), 9) / any_value(n) AS cpu, round(sum(mem), 9) / any_value(n) AS mem"
part("unions", """
  SELECT cluster, tick, list_sort(list_distinct(list(line))) AS counted,
         list_sort(list_distinct(list(split_part(line, '***', 1)))) AS funcs
  FROM (SELECT cluster, tick, trim(unnest(threaddump_data), ' ' || chr(10)) AS line FROM samples) GROUP BY ALL""", "samples")
part("ticks_v2", f"""
  SELECT t.*, coalesce(u.funcs, []) AS funcs, coalesce(u.funcs, []) AS compared
  FROM (SELECT {MEANS} FROM filled JOIN sizes USING (cluster) GROUP BY ALL) t
  LEFT JOIN unions u USING (cluster, tick)""", "filled", "sizes", "unions")
part("ticks_v1_all", f"""
  SELECT t.*, coalesce(u.funcs, []) AS funcs, coalesce(u.counted, []) AS compared
  FROM (SELECT {MEANS}, bool_or(cpu IS NULL OR mem IS NULL) AS bad
        FROM all_parsed JOIN sizes USING (cluster) GROUP BY cluster, tick) t
  LEFT JOIN unions u USING (cluster, tick)""", "all_parsed", "sizes", "unions")
part("ticks_v1_dense", "SELECT * EXCLUDE (bad) FROM ticks_v1_all WHERE NOT bad", "ticks_v1_all")
part("ticks_v1_pairs", """
  SELECT cluster, tick, cpu, mem, funcs, compared FROM (
    SELECT *, lead(NOT bad AND place % 2 = 0) OVER (PARTITION BY cluster ORDER BY tick) AS next_closes FROM (
      SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY cluster, run ORDER BY tick) AS place FROM (
        SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY cluster ORDER BY tick) AS run FROM ticks_v1_all)))
  WHERE NOT bad AND (place % 2 = 0 OR coalesce(next_closes, false))""", "ticks_v1_all")


def chain(tag: str, source: str, stride: int, variant: str) -> None:
    """Parts from snapshots to numbered visits."""
    cycle = 4 if variant == "v1" else 3
    counts = "phase <> '' AND tick_no > 1" if variant == "v1" else "phase <> ''"
    part(f"triplets_{tag}", f"""
  SELECT *, CAST(no // {stride} AS BIGINT) AS tick_no FROM (
    SELECT cluster, tick, cpu, mem, funcs, compared, row_number() OVER w AS no,
           lag(cpu, 1, 0.0) OVER w AS cpu_prev1, lag(cpu, 2, 0.0) OVER w AS cpu_prev2,
           lag(mem, 1, 0.0) OVER w AS mem_prev1, lag(mem, 2, 0.0) OVER w AS mem_prev2,
           coalesce(lag(funcs) OVER w, []) AS funcs_prev1, coalesce(lag(compared) OVER w, []) AS compared_prev1
    FROM {source} WINDOW w AS (PARTITION BY cluster ORDER BY tick)) WHERE no % {stride} = 0""", source)
    part(f"phased_{tag}", f"""
  SELECT *, md5(phase) AS phase_id FROM (
    SELECT *, array_to_string(list_transform(list_sort(
             CASE WHEN phase_changed THEN funcs ELSE list_intersect(funcs_prev1, funcs) END), lambda f: f || '->'), '') AS phase
    FROM (SELECT *, coalesce(similarity < 0.6::DOUBLE, false) AS phase_changed FROM (
      SELECT *, CASE WHEN greatest(len(compared), len(compared_prev1)) > 0 THEN
               CAST(len(list_intersect(compared_prev1, compared)) AS DOUBLE) / greatest(len(compared), len(compared_prev1)) END
             AS similarity FROM triplets_{tag})))""", f"triplets_{tag}")
    part(f"visits_{tag}", f"""
  SELECT *, NOT idle AND prior > 0 AS seen, CASE WHEN idle THEN 0 ELSE prior // {cycle} END AS version FROM (
    SELECT cluster, tick, tick_no, phase_id, phase = '' AS idle, {counts} AS counts,
           cpu, mem, cpu_prev1, cpu_prev2, mem_prev1, mem_prev2,
           CAST(coalesce(sum(CASE WHEN {counts} THEN 1 ELSE 0 END) OVER (
             PARTITION BY cluster, phase_id ORDER BY tick_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior
    FROM phased_{tag})""", f"phased_{tag}")
    # Three members of a batch side by side, one row per resource.
    place = [
        f"max(CASE WHEN prior % {cycle} = {i} THEN {{r}}{c} END) AS {n}{i}"
        for i in range(3) for c, n in (("_prev2", "a"), ("_prev1", "b"), ("", "y"))
    ]
    halves = []
    for k, r in enumerate(("cpu", "mem")):
        halves.append(f"""
    SELECT cluster, phase_id, CAST(prior // {cycle} + 1 AS BIGINT) AS version, '{r}' AS resource, {k} AS rno,
           {', '.join(p.format(r=r) for p in place)}
    FROM visits_{tag} WHERE counts GROUP BY ALL HAVING count(*) = {cycle}""")
    part(f"batches_{tag}", " UNION ALL ".join(halves), f"visits_{tag}")


chain("s2", "ticks_v2", 2, "v2")
chain("s1", "ticks_v2", 1, "v2")
chain("p2", "ticks_v1_pairs", 2, "v1")
chain("p1", "ticks_v1_dense", 1, "v1")

oracle("parse_resource_lines", "SELECT * FROM parsed", "parsed")
oracle("locf_resources", "SELECT * FROM filled", "filled")
oracle("cluster_mean_fixed_divisor", f"""
  SELECT cluster, tick, round(cpu, 6) AS cpu, round(mem, 6) AS mem FROM (
    SELECT {MEANS} FROM present_filled JOIN sizes USING (cluster) GROUP BY cluster, tick)""", "present_filled", "sizes")
oracle("missing_workers", "SELECT * FROM missing", "missing")
oracle("function_union", """
  SELECT cluster, tick, array_to_string(funcs, '|') AS funcs, array_to_string(counted, '|') AS counted FROM unions""", "unions")
oracle("latest_sample", """
  SELECT cluster, worker, arg_max(resource_data, tick) AS resource_data, max(tick) AS tick FROM samples GROUP BY cluster, worker""",
       "samples")
VALUES = ", ".join(f"round({r}{s}, 6) AS {r}{s}" for r in ("cpu", "mem") for s in ("_prev2", "_prev1", ""))
oracle("triplets", f"""
  SELECT cluster, tick, tick_no, {VALUES}, array_to_string(funcs_prev1, '|') AS funcs_prev1, array_to_string(funcs, '|') AS funcs
  FROM triplets_s2""", "triplets_s2")
oracle("stack_similarity", "SELECT cluster, tick_no, round(similarity, 6) AS similarity, phase_changed FROM phased_s1", "phased_s1")
oracle("phase_keys", "SELECT cluster, tick_no, phase, phase_id FROM phased_s1", "phased_s1")
VISIT = "cluster, tick, tick_no, phase_id, idle, prior, seen, version"
oracle("phase_visits", f"SELECT {VISIT} FROM visits_s2", "visits_s2")
oracle("phase_visits_v1", f"SELECT {VISIT} FROM visits_p2", "visits_p2")
oracle("idle_and_first_tick_guards", """
  SELECT cluster, tick_no, phase_id, prior = 0 AS first, 'v2' AS variant FROM visits_s1 WHERE counts
  UNION ALL SELECT cluster, tick_no, phase_id, prior = 0, 'v1' FROM visits_p1 WHERE counts""", "visits_s1", "visits_p1")

# --- models and predictions -----------------------------------------------------------------


def lasso(source: str, keep: str, n: int, alpha: str = "0.1::DOUBLE") -> str:
    """Fit each row of ``source`` that has points (a_i, b_i, y_i), i < n."""
    def total(f):
        return "(" + " + ".join(f(i) for i in range(n)) + ")"

    moments = ", ".join(
        f"{total(lambda i: f'({u}{i} - m{u}) * ({v}{i} - m{v})')} / {n} AS {name}"
        for name, u, v in (("s11", "a", "a"), ("s12", "a", "b"), ("s22", "b", "b"), ("c1", "a", "y"), ("c2", "b", "y"))
    )
    means = ", ".join(f"{total(lambda i: f'{u}{i}')} / {n} AS m{u}" for u in "aby")
    both = []
    for rank, (g, h) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1)), start=3):
        both.append(f"""
      SELECT {rank} AS rank, (s22 * (c1 - {g} * {alpha}) - s12 * (c2 - {h} * {alpha})) / det AS w1,
             (s11 * (c2 - {h} * {alpha}) - s12 * (c1 - {g} * {alpha})) / det AS w2, {g} AS g, {h} AS h
      WHERE det > 1e-12::DOUBLE * s11 * s22""")
    return f"""
  SELECT {keep}, best.w1 AS w_prev2, best.w2 AS w_prev1, my - best.w1 * ma - best.w2 * mb AS intercept
  FROM (SELECT *, (
    SELECT arg_min({{'w1': w1, 'w2': w2}}, {{'cost': 0.5::DOUBLE * (s11 * w1 * w1 + 2 * s12 * w1 * w2 + s22 * w2 * w2)
             - (c1 * w1 + c2 * w2 - {alpha} * (abs(w1) + abs(w2))), 'rank': rank}})
    FROM (
      SELECT 0 AS rank, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0 AS g, 0 AS h
      UNION ALL
      SELECT 1, CASE WHEN s11 > 0 THEN greatest(abs(c1) - {alpha}, 0) * sign(c1) / s11 ELSE 0 END, 0, 0, 0
      UNION ALL
      SELECT 2, 0, CASE WHEN s22 > 0 THEN greatest(abs(c2) - {alpha}, 0) * sign(c2) / s22 ELSE 0 END, 0, 0
      UNION ALL {' UNION ALL '.join(both)}) AS candidates
    WHERE w1 * g >= 0 AND w2 * h >= 0 AND (g = 0 OR (w1 <> 0 AND w2 <> 0))) AS best
  FROM (SELECT *, s11 * s22 - s12 * s12 AS det FROM (
    SELECT *, {moments} FROM (SELECT *, {means} FROM {source}))))"""


for _tag in ("s1", "p1"):
    part(f"lasso_{_tag}", lasso(f"batches_{_tag}", "cluster, phase_id, version, resource", 3), f"batches_{_tag}")

WEIGHTS = "round(w_prev2, 6) AS w_prev2, round(w_prev1, 6) AS w_prev1, round(intercept, 6) AS intercept"
oracle("lasso_models", f"SELECT cluster, phase_id, version, resource, {WEIGHTS}, CAST(3 AS BIGINT) AS n FROM lasso_s1", "lasso_s1")

_sum = lambda f: "round(" + " + ".join(f.replace("#", str(i)) for i in range(3)) + ", 6)"
oracle("profile_batches", "SELECT cluster, phase_id, version, resource, " + ", ".join(
    f"{_sum(f)} AS sum_{n}" for n, f in (
        ("x1", "a#"), ("x2", "b#"), ("y", "y#"), ("x1x1", "a# * a#"), ("x1x2", "a# * b#"), ("x2x2", "b# * b#"),
        ("x1y", "a# * y#"), ("x2y", "b# * y#"))
) + ", CAST(3 AS BIGINT) AS n FROM batches_s1", "batches_s1")

# Each step of the replay recursion fits the next version of every phase and resource from three real
# points and five drawn ones that the model before has labelled.
_draw = lambda place: (
    f"((CAST('0x' || substr(phase_id, 1, 8) AS BIGINT) + 7919 * version + 104729 * {place} + 1299709 * rno) % 2147483647)"
)
_points = ", ".join(
    f"CAST({_draw(2 * i)} * {_draw(2 * i)} % 2147483647 % 99 + 1 AS DOUBLE) AS a{3 + i}, "
    f"CAST({_draw(2 * i + 1)} * {_draw(2 * i + 1)} % 2147483647 % 99 + 1 AS DOUBLE) AS b{3 + i}"
    for i in range(5)
)
_labels = ", ".join(f"p.w_prev2 * n.a{i} + p.w_prev1 * n.b{i} + p.intercept AS y{i}" for i in range(3, 8))
part("drawn", f"SELECT *, {_points} FROM batches_s1", "batches_s1")
part("replayed", "SELECT * FROM lasso_s1 WHERE version = 1 UNION ALL SELECT * FROM (" + lasso(
    f"(SELECT n.*, {_labels} FROM replayed p JOIN drawn n ON n.cluster = p.cluster AND n.phase_id = p.phase_id "
    "AND n.resource = p.resource AND n.version = p.version + 1)",
    "cluster, phase_id, version, resource", 8) + ")", "lasso_s1", "drawn")
oracle("lasso_replay", f"SELECT cluster, phase_id, version, resource, {WEIGHTS}, CAST(3 AS BIGINT) AS n FROM replayed", "replayed")

part("agg_long", """
  SELECT cluster, phase_id, version, resource, (a0 + b0 + a1 + b1 + a2 + b2) / 7 AS m FROM batches_p1 WHERE version = 1
  UNION ALL
  SELECT n.cluster, n.phase_id, n.version, n.resource, (n.a0 + n.b0 + n.a1 + n.b1 + n.a2 + n.b2 + p.m) / 7
  FROM agg_long p JOIN batches_p1 n ON n.cluster = p.cluster AND n.phase_id = p.phase_id AND n.resource = p.resource
   AND n.version = p.version + 1""", "batches_p1")
part("agg_models", """
  SELECT cluster, phase_id, version, max(CASE WHEN resource = 'cpu' THEN m END) AS cpu_mean,
         max(CASE WHEN resource = 'mem' THEN m END) AS mem_mean FROM agg_long GROUP BY ALL""", "agg_long")
oracle("agg_models", """
  SELECT cluster, phase_id, version, round(cpu_mean, 6) AS cpu_mean, round(mem_mean, 6) AS mem_mean FROM agg_models""", "agg_models")


def predictions(tag: str, algo: str) -> str:
    if algo == "simple":
        return f"""SELECT v.*, CASE WHEN idle THEN 0.0 ELSE cpu_prev1 END AS predicted_cpu,
           CASE WHEN idle THEN 0.0 ELSE mem_prev1 END AS predicted_mem FROM visits_{tag} v"""
    if algo == "agg":
        return f"""SELECT v.*,
           CASE WHEN idle THEN 0.0 WHEN cpu_mean <> 0 OR mem_mean <> 0 THEN cpu_mean ELSE cpu_prev1 END AS predicted_cpu,
           CASE WHEN idle THEN 0.0 WHEN cpu_mean <> 0 OR mem_mean <> 0 THEN mem_mean ELSE mem_prev1 END AS predicted_mem
    FROM visits_{tag} v LEFT JOIN agg_models m USING (cluster, phase_id, version)"""
    made = [
        f"CASE WHEN idle THEN 0.0 ELSE coalesce({x}.w_prev2 * {r}_prev2 + {x}.w_prev1 * {r}_prev1 + {x}.intercept, {r}_prev1) END"
        f" AS predicted_{r}" for x, r in (("c", "cpu"), ("m", "mem"))
    ]
    joins = " ".join(
        f"LEFT JOIN lasso_{tag} {x} ON {x}.resource = '{r}' AND {x}.cluster = v.cluster AND {x}.phase_id = v.phase_id "
        f"AND {x}.version = v.version" for x, r in (("c", "cpu"), ("m", "mem"))
    )
    return f"SELECT v.*, {', '.join(made)} FROM visits_{tag} v {joins}"


PREDICTED = (
    "cluster, tick_no, phase_id, seen, version, round(predicted_cpu, 6) AS predicted_cpu, round(predicted_mem, 6) AS predicted_mem"
)
part("predicted_simple_s2", predictions("s2", "simple"), "visits_s2")
part("predicted_s1", predictions("s1", "lasso"), "visits_s1", "lasso_s1")
part("predicted_agg", predictions("p1", "agg"), "visits_p1", "agg_models")
part("predicted_simple_p1", predictions("p1", "simple"), "visits_p1")
part("predicted_lasso_p1", predictions("p1", "lasso"), "visits_p1", "lasso_p1")
oracle("predict_simple", f"SELECT {PREDICTED} FROM predicted_simple_s2", "predicted_simple_s2")
oracle("lasso_predict", f"SELECT {PREDICTED} FROM predicted_s1", "predicted_s1")
oracle("agg_predict", f"SELECT {PREDICTED} FROM predicted_agg", "predicted_agg")
oracle("algo_choice", f"""
  SELECT {PREDICTED}, 'simple' AS algo FROM predicted_simple_p1
  UNION ALL SELECT {PREDICTED}, 'lasso' FROM predicted_lasso_p1
  UNION ALL SELECT {PREDICTED}, 'agg' FROM predicted_agg""", "predicted_simple_p1", "predicted_lasso_p1", "predicted_agg")

# --- accuracy and anomalies -------------------------------------------------------------------

TERM = {r: f"abs({r} - predicted_{r}) / (abs({r}) + abs(predicted_{r}) + 1e-8::DOUBLE)" for r in ("cpu", "mem")}
part("accuracy_s1", "SELECT cluster, " + ", ".join(f"100 - avg({t}) * 100 AS acc_{r}" for r, t in TERM.items())
     + " FROM predicted_s1 GROUP BY cluster", "predicted_s1")
oracle("smape_accuracy", "SELECT cluster, round(acc_cpu, 6) AS acc_cpu, round(acc_mem, 6) AS acc_mem FROM accuracy_s1", "accuracy_s1")


oracle("paired_accuracy", "SELECT cluster, " + ", ".join(f"round(100 - avg({t}) * 100, 6) AS acc_{r}" for r, t in TERM.items())
       + " FROM predicted_simple_s2 GROUP BY cluster", "predicted_simple_s2")


def score(tag: str, source: str) -> None:
    solid = lambda c: f"(CASE WHEN {c} = 0 THEN 0.001::DOUBLE ELSE {c} END)"
    terms = [f"abs(({solid('predicted_' + r)} - {solid(r)}) / {solid('predicted_' + r)})" for r in ("cpu", "mem")]
    over = "OVER (PARTITION BY cluster ORDER BY tick_no)"
    running = ", ".join(f"100 - avg({t}) {over} * 100 AS acc_{r}" for r, t in TERM.items())
    part(f"steps_{tag}", f"""
  SELECT *, CASE WHEN idle THEN 0 WHEN (CASE WHEN seen THEN mape > 50 ELSE cpu < 10 END) THEN 1 ELSE -1 END AS step
  FROM (SELECT *, ({terms[0]} + {terms[1]}) / 2 * 100 AS mape FROM {source})""", source)
    part(f"scored_{tag}", f"""
  SELECT *, CAST(sum(step) {over} AS BIGINT) AS confidence, {running} FROM steps_{tag}""", f"steps_{tag}")


part("lasso_s2", lasso("batches_s2", "cluster, phase_id, version, resource", 3), "batches_s2")
part("predicted_s2", predictions("s2", "lasso"), "visits_s2", "lasso_s2")
score("s1", "predicted_s1")
score("s2", "predicted_s2")
oracle("running_accuracy", "SELECT cluster, tick_no, round(acc_cpu, 6) AS acc_cpu, round(acc_mem, 6) AS acc_mem FROM scored_s1", "scored_s1")
oracle("anomaly_steps", """
  SELECT cluster, tick_no, idle, seen, round(mape, 6) AS mape, CAST(step AS BIGINT) AS step FROM steps_s1""", "steps_s1")
oracle("anomaly_confidence", "SELECT cluster, tick_no, CAST(step AS BIGINT) AS step, confidence FROM scored_s1", "scored_s1")
oracle("anomaly_alerts", "SELECT cluster, tick, tick_no, phase_id, confidence FROM scored_s2 WHERE confidence > 5", "scored_s2")
oracle("anomaly_first_alert", """
  SELECT cluster, tick_no, confidence, confidence > 5 AS alert FROM scored_s2 s
  WHERE tick_no <= coalesce((SELECT min(tick_no) FROM scored_s2 f WHERE f.cluster = s.cluster AND f.confidence > 5), tick_no)""",
       "scored_s2")

oracle("watch_minutes", """
  SELECT cluster, tick, tick_no, phase_id, seen, version, confidence, confidence > 5 AS alert, round(cpu, 6) AS cpu, round(mem, 6) AS mem,
         round(predicted_cpu, 6) AS predicted_cpu, round(predicted_mem, 6) AS predicted_mem,
         round(acc_cpu, 6) AS acc_cpu, round(acc_mem, 6) AS acc_mem FROM scored_s2""", "scored_s2")
ORACLES["watch_minutes"] = ORACLES["watch_minutes"].replace("event_id // 4 AS tick", "event_id AS tick")

# --- runs, processes, traffic -------------------------------------------------------------------

part("process_rows", """
  SELECT cluster, worker, tick, CASE WHEN e.event_type <> 'error' THEN e.k % 3 + 100 END AS pid,
         CASE WHEN e.k % 7 = 0 THEN 'PID USER %CPU %MEM' ELSE CAST(CAST(e.value AS DECIMAL(18,2)) AS VARCHAR) || ',' || e.k END AS line
  FROM (SELECT cluster, worker, tick,
               arg_max({'event_type': event_type, 'value': value, 'k': k}, event_id) AS e FROM ev GROUP BY ALL)""", "ev")
LIVE = "CASE WHEN pid IS NULL OR line LIKE '%CPU%' THEN '0,0' ELSE line END"
oracle("process_samples", f"SELECT cluster, worker, tick, pid, {LIVE} AS line FROM process_rows", "process_rows")
part("changes", """
  SELECT cluster, worker, tick, pid FROM (
    SELECT *, last_value(pid IGNORE NULLS) OVER (PARTITION BY cluster, worker ORDER BY tick
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM process_rows)
  WHERE pid IS NOT NULL AND pid IS DISTINCT FROM before""", "process_rows")
oracle("workload_change_log", "SELECT * FROM changes", "changes")
oracle("workload_log_scan", "SELECT cluster, worker, tick * 3600 AS ts, pid FROM changes", "changes")
part("sample_numbers", """
  SELECT cluster, worker, tick, pid, line, CASE WHEN pid IS NOT NULL THEN
           row_number() OVER (PARTITION BY cluster, worker, run, pid IS NULL ORDER BY tick) - 1 END AS sample_no FROM (
    SELECT *, sum(CASE WHEN pid IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY cluster, worker ORDER BY tick) AS run
    FROM process_rows)""", "process_rows")
oracle("run_sample_no", "SELECT cluster, worker, tick, pid, sample_no FROM sample_numbers", "sample_numbers")
oracle("resource_history", f"""
  SELECT cluster, worker, pid, CASE WHEN line LIKE '%CPU%' THEN 0 ELSE sample_no END AS count,
         CAST(split_part({LIVE}, ',', 1) AS DOUBLE) AS cpu, CAST(split_part({LIVE}, ',', 2) AS DOUBLE) AS mem
  FROM sample_numbers WHERE pid IS NOT NULL""", "sample_numbers")
part("processes", """
  SELECT *, CASE WHEN pid > 0 THEN (pid - 1) // 4 END AS ppid,
         CAST(split_part(host, '-', 2) AS BIGINT) % 4 < 3 AND pid = CAST(split_part(host, '-', 2) AS BIGINT) % 4 + 10 AS is_main
  FROM (SELECT 'host-' || (event_id // 500) AS host, event_id % 500 AS pid, value AS cpu, CAST(k AS DOUBLE) AS mem FROM ev)""", "ev")
part("tree", """
  SELECT host, pid, ppid, is_main, cpu, mem FROM processes WHERE is_main
  UNION ALL
  SELECT c.host, c.pid, c.ppid, c.is_main, c.cpu, c.mem FROM tree t JOIN processes c ON c.host = t.host AND c.ppid = t.pid""", "processes")
oracle("process_tree", "SELECT host, pid, ppid, is_main FROM tree", "tree")
part("traffic", """
  SELECT 'host-' || (event_id // 500) AS host, event_id % 500 AS line_no,
    CASE WHEN event_id % 500 % 10 = 9 OR event_id % 500 % 50 = 10 THEN 'Refreshing:'
         WHEN event_type = 'error' THEN 'short 1'
         WHEN event_type = 'signup' THEN 'ssh/' || k || '/0 ' || CAST(value AS DECIMAL(18,2)) || ' ' || k
         ELSE 'java/' || k || '/0 ' || CAST(value AS DECIMAL(18,2)) || ' ' || k END AS line
  FROM ev""", "ev")
part("chunked", """
  SELECT * FROM (
    SELECT host, line_no, line, sum(CASE WHEN line = 'Refreshing:' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY line_no)
             - CASE WHEN line = 'Refreshing:' THEN 1 ELSE 0 END AS chunk,
           sum(CASE WHEN line = 'Refreshing:' THEN 1 ELSE 0 END) OVER (PARTITION BY host) AS closed
    FROM traffic) WHERE chunk < closed""", "traffic")


def usage(match: str) -> str:
    return f"""
  SELECT host, CAST(chunk AS BIGINT) AS chunk, round(coalesce(sum(up), 0), 6) AS upload, round(coalesce(sum(down), 0), 6) AS download,
         round(coalesce(sum(cpu), 0), 6) AS cpu, round(coalesce(sum(mem), 0), 6) AS mem
  FROM (
    SELECT l.host, l.chunk, l.line_no,
           CASE WHEN counts AND (helper OR p.pid IS NOT NULL) THEN CAST(split_part(line, ' ', 2) AS DOUBLE) END AS up,
           CASE WHEN counts AND (helper OR p.pid IS NOT NULL) THEN CAST(split_part(line, ' ', 3) AS DOUBLE) END AS down, p.cpu, p.mem
    FROM (SELECT *, len(string_split(line, ' ')) >= 3 AND host IN (SELECT host FROM tree) AS counts,
                 contains(split_part(line, ' ', 1), 'ssh/') AS helper FROM chunked) l
    LEFT JOIN tree p ON p.host = l.host AND l.counts AND NOT l.helper AND {match}
    QUALIFY row_number() OVER (PARTITION BY l.host, l.line_no ORDER BY p.is_main DESC NULLS LAST, p.pid) = 1)
  GROUP BY host, chunk"""


oracle("traffic_chunks", usage("contains(split_part(l.line, ' ', 1), CAST(p.pid AS VARCHAR))"), "tree", "chunked")
oracle("traffic_chunks_exact", usage("split_part(l.line, '/', 2) = CAST(p.pid AS VARCHAR)"), "tree", "chunked")
oracle("stream_chunks", """
  SELECT host, CAST(chunk AS BIGINT) AS chunk, CAST(sum(CASE WHEN line <> 'Refreshing:' THEN 1 ELSE 0 END) AS INTEGER) AS lines
  FROM chunked GROUP BY host, chunk""", "chunked")

oracle("traffic_log_scan", """
  SELECT host, CAST(chunk AS BIGINT) AS chunk, CAST(sum(CASE WHEN line <> 'Refreshing:' THEN 1 ELSE 0 END) AS BIGINT) AS lines
  FROM chunked GROUP BY host, chunk""", "chunked")

# --- dumps and text -----------------------------------------------------------------------

part("dump_lines", """
  SELECT event_id // 20 AS dump_no, event_id * 10 + i AS no, line FROM (
    SELECT event_id, unnest(range(5)) AS i, unnest([
      CASE WHEN event_id % 11 = 0 THEN NULL ELSE (k % 9 + 1) || ' threads with trace' END,
      'Stack:',
      CASE WHEN k % 2 = 0 THEN 'at org.apache.spark.' ELSE 'at java.util.' END || event_type || ' ',
      'at run',
      CASE WHEN event_id % 13 = 0 THEN NULL ELSE '' END]) AS line FROM ev)
  WHERE line IS NOT NULL""", "ev")
part("stacks", """
  SELECT DISTINCT dump_no, stack, threads FROM (
    SELECT dump_no, block, string_agg(line, '' ORDER BY no) FILTER (inside OR line = 'Stack:') AS stack,
           arg_max(split_part(line, ' ', 1), no) FILTER (line LIKE '%threads with trace%') AS threads,
           bool_or(line = '') AS closed
    FROM (
      SELECT *, coalesce(max(CASE WHEN line = 'Stack:' THEN no END) OVER (PARTITION BY dump_no, block ORDER BY no), -1) >= 0 AS inside
      FROM (SELECT *, coalesce(sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (
              PARTITION BY dump_no ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM dump_lines))
    GROUP BY dump_no, block)
  WHERE closed AND contains(stack, 'spark')""", "dump_lines")
oracle("dump_files", "SELECT dump_no, stack, threads FROM stacks", "stacks")
ORACLES["dump_files"] = ORACLES["dump_files"].replace("event_id // 20 AS", "event_id // 1000 AS")
oracle("dump_large_file", "SELECT dump_no, stack, threads FROM stacks", "stacks")
ORACLES["dump_large_file"] = ORACLES["dump_large_file"].replace(
    "event_id // 20 AS dump_no", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id // 1000 + 1 END AS dump_no")
oracle("dump_stacks", "SELECT dump_no, stack, threads, stack || ' *** ' || threads AS line FROM stacks", "stacks")
oracle("dump_stack_counts", "SELECT dump_no, count(*) AS stacks FROM stacks GROUP BY dump_no", "stacks")
oracle("stack_text", "SELECT stack || ' *** ' || coalesce(threads, '-1') AS value, count(*) AS times FROM stacks GROUP BY 1", "stacks")
oracle("doc_blocks", """
  WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
  marked AS (
    SELECT *, CASE WHEN i > 0 AND line[1] IN ('E', 'T') THEN 1 ELSE 0 END AS mark FROM lines),
  numbered AS (SELECT *, sum(mark) OVER (PARTITION BY doc_id ORDER BY i) AS block_no FROM marked)
  SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, CAST(count(*) AS INTEGER) AS lines,
         md5(string_agg(line, chr(10) ORDER BY i)) AS digest
  FROM numbered GROUP BY doc_id, block_no""")

# --- comparison -------------------------------------------------------------------------------

part("repeats", """
  SELECT o_orderkey, algo, workload, repeat, repeat_in_part, CASE WHEN ok THEN round(cpu, 6) END AS CPU, round(mem, 6) AS MEM FROM (
    SELECT o_orderkey, o_orderstatus AS algo, replace(split_part(o_orderpriority, '-', 2), ' ', '_') AS workload,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS repeat, o_orderkey % 37 <> 0 AS ok,
           row_number() OVER (PARTITION BY o_orderstatus, o_orderkey // 1000 ORDER BY o_orderkey) AS repeat_in_part,
           CAST(CAST(o_totalprice % 100 AS DECIMAL(18,3)) AS DOUBLE) AS cpu, CAST(o_custkey % 100 AS DOUBLE) AS mem
    FROM orders) WHERE o_orderkey % 41 <> 0""")
oracle("stats_file_parse", "SELECT * EXCLUDE (o_orderkey, repeat_in_part) FROM repeats", "repeats")
oracle("stats_file_scan", """
  SELECT algo, o_orderkey // 1000 AS part, workload,
         repeat_in_part AS repeat, CPU, MEM FROM repeats""", "repeats")
part("averages", "SELECT algo, workload, avg(CPU) AS CPU, avg(MEM) AS MEM FROM repeats GROUP BY ALL", "repeats")
_pivot = lambda stat: ", ".join(f"round(max(CASE WHEN algo = '{a}' THEN {stat} END), 6) AS {a}" for a in "FOP")
oracle("compare_workloads", f"SELECT workload, {_pivot('CPU')} FROM averages GROUP BY workload", "averages")
oracle("compare_csv", " UNION ALL ".join(
    f"SELECT workload, {_pivot(s)}, '{s}' AS stat FROM averages GROUP BY workload" for s in ("CPU", "MEM")), "averages")
oracle("equal_repeats", """
  SELECT algo, min(n) AS least, max(n) AS most FROM (
    SELECT algo, workload, count(*) AS n FROM repeats GROUP BY ALL
    UNION ALL SELECT o_orderstatus, 'broken', 0 FROM orders WHERE o_orderkey % 41 = 0 GROUP BY o_orderstatus)
  GROUP BY algo HAVING min(n) <> max(n)""", "repeats")

# --- writing and reading back -----------------------------------------------------------------

POINT = f"strftime(TIMESTAMP '2024-01-01' + to_seconds(tick), {STAMP}) AS time, 'runner-' || cluster AS host, 'hourly' AS experiment_name"
oracle("predictions_points", f"""
  SELECT {POINT}, round(cpu, 6) AS actual_cpu, round(mem, 6) AS actual_mem, round(predicted_cpu, 6) AS predicted_cpu,
         round(predicted_mem, 6) AS predicted_mem FROM scored_s1""", "scored_s1")
_over = "OVER (PARTITION BY cluster ORDER BY tick_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
oracle("accuracy_points", f"""
  SELECT * FROM (SELECT {POINT}, {', '.join(f'round(100 - avg({t}) {_over} * 100, 6) AS acc_{r}' for r, t in TERM.items())}
  FROM predicted_simple_p1) WHERE acc_cpu IS NOT NULL""", "predicted_simple_p1")
oracle("metric_points", """
  SELECT measurement, host, experiment_name, count(*) AS n, max(value) AS max_value, round(sum(k), 6) AS sum_k
  FROM points GROUP BY ALL""", "points")
HALF = "(SELECT max(tick) // 2 FROM visits_s1)"
part("early", f"SELECT * FROM visits_s1 WHERE tick < {HALF} AND counts", "visits_s1")
part("early_full", """
  SELECT cluster, phase_id, prior // 3 AS b FROM early GROUP BY ALL HAVING count(*) = 3""", "early")
oracle("phase_db_roundtrip", f"""
  SELECT cluster, 2 * count(*) AS n, 'pending' AS part FROM early e
  WHERE NOT EXISTS (SELECT 1 FROM early_full f WHERE f.cluster = e.cluster AND f.phase_id = e.phase_id AND f.b = e.prior // 3)
  GROUP BY cluster
  UNION ALL SELECT cluster, 2 * count(*), 'models' FROM early_full GROUP BY cluster
  UNION ALL
  SELECT cluster, count(*), CASE WHEN known THEN 'known' ELSE 'new' END FROM (
    SELECT cluster, (cluster, phase_id) IN (SELECT (cluster, phase_id) FROM early) AS known
    FROM visits_s1 WHERE tick >= {HALF} AND NOT idle) GROUP BY ALL""", "early", "early_full", "visits_s1")
oracle("resumed_watch", f"""
  SELECT cluster, tick, phase_id, seen, version, CAST(step AS BIGINT) AS step, round(predicted_cpu, 6) AS predicted_cpu,
         round(predicted_mem, 6) AS predicted_mem, round(mape, 6) AS mape FROM steps_s1 WHERE tick >= {HALF}""", "steps_s1", "visits_s1")
oracle("summary_append", """
  SELECT cluster, CAST(unnest(range(4)) AS BIGINT) AS line_no, unnest(['', '### Accuracy Rates ###',
    'CPU Prediction Accuracy: ' || printf('%.3f', acc_cpu), 'MEM Prediction Accuracy: ' || printf('%.3f', acc_mem)]) AS line
  FROM accuracy_s1""", "accuracy_s1")
score("v1", "predicted_simple_p1")
oracle("summary_append_v1", """
  SELECT * FROM (
    SELECT cluster, CAST(unnest(range(5)) AS BIGINT) AS line_no, unnest(['', '### Accuracy Rates ###',
      'CPU Prediction Accuracy: ' || printf('%.3f', acc_cpu), 'MEM Prediction Accuracy: ' || printf('%.3f', acc_mem),
      CASE WHEN alert THEN 'Anomaly Detected' END]) AS line
    FROM (SELECT cluster, """ + ", ".join(f"100 - avg({t}) * 100 AS acc_{r}" for r, t in TERM.items())
       + """, bool_or(confidence > 5) AS alert FROM scored_v1 GROUP BY cluster)) WHERE line IS NOT NULL""", "scored_v1")
# The origin is 568,022,400 times three seconds after the epoch.
oracle("polled_samples", """
  SELECT cluster, worker, 568022400 + tick // 3 AS tick, arg_max(resource_data, tick) AS resource_data
  FROM samples GROUP BY cluster, worker, tick // 3""", "samples")
oracle("samples_json_roundtrip", """
  SELECT cluster, worker, tick, resource_data, array_to_string(threaddump_data, '|') AS threaddump_data FROM samples
  UNION ALL SELECT cluster, worker, tick, '0,0', '' FROM missing""", "samples", "missing")

# --- streams: the batch result -----------------------------------------------------------------

oracle("stream_window_mean", f"""
  SELECT measurement, host, strftime(w, {STAMP}) AS window_start, round(m, 6) AS mean FROM (
    SELECT measurement, host, {bucket('5 minutes')} AS w, avg(value) AS m FROM points GROUP BY ALL)
  WHERE m <> 0""", "points")
_stream = lambda source: f"""
  SELECT cluster, tick_no, strftime(TIMESTAMP '2024-01-01' + to_seconds(tick), {STAMP}) AS tick, phase_id, idle, seen, version,
         round(predicted_cpu, 6) AS predicted_cpu, round(predicted_mem, 6) AS predicted_mem, CAST(step AS BIGINT) AS step, confidence,
         confidence > 5 AS alert, round(acc_cpu, 6) AS acc_cpu, round(acc_mem, 6) AS acc_mem
  FROM {source}"""
oracle("stream_points", f"""
  SELECT strftime(TIMESTAMP '2024-01-01' + to_seconds(tick), {STAMP}) AS time, 'runner-live' AS host, 'hourly' AS experiment_name,
         round(cpu, 6) AS actual_cpu, round(mem, 6) AS actual_mem, round(predicted_cpu, 6) AS predicted_cpu,
         round(predicted_mem, 6) AS predicted_mem
  FROM scored_s1""", "scored_s1")
oracle("stream_anomaly", _stream("scored_s1"), "scored_s1")
# The last tick before the stop is closed by the samples after it, so it belongs to the second run.
part("restarted", """
  SELECT * REPLACE (CAST(sum(step) OVER (PARTITION BY cluster, tick >= (SELECT max(tick) // 2 - 1 FROM samples) ORDER BY tick_no) AS BIGINT)
           AS confidence) FROM scored_s1""", "scored_s1", "samples")
oracle("stream_restart", _stream("restarted"), "restarted")

part("ends", "SELECT cluster, min(tick) AS last FROM missing GROUP BY cluster", "missing")
_ended = lambda tick: f"""
  SELECT cluster, {tick("tick")} AS tick, tick_no, confidence, confidence > 5 AS alert
  FROM scored_s1 LEFT JOIN ends USING (cluster) WHERE last IS NULL OR tick < last
  UNION ALL SELECT cluster, {tick("last")}, NULL, NULL, TRUE FROM ends"""
for _name, _tick in (("missing_worker_ends", str), ("stream_missing_worker", lambda t: f"strftime(TIMESTAMP '2024-01-01' + to_seconds({t}), {STAMP})")):
    oracle(_name, _ended(_tick), "scored_s1", "ends")
    ORACLES[_name] = ORACLES[_name].replace("event_id // 4 AS tick", "event_id // 100 AS tick")
oracle("stream_pairs", _stream("scored_s2"), "scored_s2")
oracle("stream_until_alert", _stream("""(
    SELECT * FROM scored_s2 s
    WHERE tick_no <= coalesce((SELECT min(tick_no) FROM scored_s2 f WHERE f.cluster = s.cluster AND f.confidence > 5), tick_no))"""),
       "scored_s2")
oracle("stream_empty_function", _stream("scored_s1"), "scored_s1", "missing")
_SETS = "coalesce(u.funcs, []) AS funcs, coalesce(u.funcs, []) AS compared"
_SAID = """list_sort(list_distinct(list_concat(coalesce(u.funcs, []),
             CASE WHEN (t.cluster, t.tick) IN (SELECT (cluster, tick) FROM missing) THEN [''] ELSE [] END)))"""
ORACLES["stream_empty_function"] = ORACLES["stream_empty_function"].replace(_SETS, f"{_SAID} AS funcs, {_SAID} AS compared")
oracle("stream_latencies", f"""
  SELECT measurement, 'runner-live' AS host, 'hourly' AS experiment_name,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(tick // 3600 * 3600), {STAMP}) AS hour, count(*) AS ticks
  FROM scored_s1 CROSS JOIN (SELECT unnest(['prediction_latency', 'ml_model_update_latency', 'anomaly_detection_latency']) AS measurement)
  GROUP BY ALL""", "scored_s1")
oracle("stream_resources", f"""
  SELECT strftime(TIMESTAMP '2024-01-01' + to_seconds(chunk), {STAMP}) AS time, host, 'traffic' AS experiment_name,
         upload, download, cpu, mem
  FROM ({usage("contains(split_part(l.line, ' ', 1), CAST(p.pid AS VARCHAR))")})""", "tree", "chunked")


def settle_rounding(sql: str) -> str:
    """Replace each ``round(x, 6)`` by one over nine exact decimal places, so that ties do not hang on float noise."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        inner = sql[start + 6 : end]
        out.append(sql[at:start])
        if inner.endswith(", 6"):
            out.append(f"CAST(round(CAST({settle_rounding(inner[:-3])} AS DECIMAL(38,9)), 6) AS DOUBLE)")
        else:
            out.append(f"round({settle_rounding(inner)})")
        at = end + 1
    return "".join(out) + sql[at:]


ORACLES = {name: settle_rounding(sql) for name, sql in ORACLES.items()}
