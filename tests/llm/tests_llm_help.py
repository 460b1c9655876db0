"""Plain helpers of the tests."""


def classes(nodes, pairs):
    """The smallest node of each node's component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
