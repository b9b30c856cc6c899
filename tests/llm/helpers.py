"""Plain counterparts of the operators, and texts for tests."""

import re

#: Names that operators use inside; documents may have columns of these names.
NAMES = ["kept", "size", "row", "digest", "chunk", "recipe", "f", "g", "d", "c", "n", "place", "ids", "spans", "_text", "_id", "doc",
         "component_id", "taken", "target", "count", "term"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "tho an er ing ea st re ly wh ti on ou ed ha nd sh or at ble".split()


def prose(rng, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in collected(df)}


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def roots(nodes, linked):
    """The smallest node each node reaches."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
