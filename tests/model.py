"""An independent model of the prefix tree in plain Python: a stack over sorted prefixes."""

from __future__ import annotations


def tree(objects: list[tuple[str, int]], max_depth: int = 0) -> list[dict]:
    sums: dict[str, list[int]] = {}
    for key, size in objects:
        cuts = [""] + [key[: i + 1] for i, c in enumerate(key) if c == "/"]
        for p in cuts[: max_depth + 1] if max_depth else cuts:
            own = sums.setdefault(p, [0, 0])
            own[0] += 1
            own[1] += size
    nodes = [{"prefix": p, "depth": p.count("/"), "pos": i, "object_count": sums[p][0], "total_bytes": sums[p][1]} for i, p in enumerate(sorted(sums, key=lambda x: x.encode("utf-8", "surrogatepass")))]
    stack: list[dict] = []
    for n in [*nodes, {"prefix": None, "pos": len(nodes), "depth": 0}]:
        while stack and (n["prefix"] is None or not n["prefix"].startswith(stack[-1]["prefix"])):
            done = stack.pop()
            done["subtree_end"] = n["pos"] - 1
            if stack:
                stack[-1]["max_depth_in_subtree"] = max(stack[-1]["max_depth_in_subtree"], done["max_depth_in_subtree"])
        if n["prefix"] is not None:
            n["max_depth_in_subtree"] = n["depth"]
            stack.append(n)
    return nodes
