def brute_components(nodes, edges):
    """node -> smallest node reachable."""
    label = {n: n for n in nodes}
    again = True
    while again:
        again = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                again = True
    return label
