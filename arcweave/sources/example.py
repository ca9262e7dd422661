"""A tiny archive as relations: two origins, 24 nodes and 28 arcs. Its urls and all rows below are fixed values."""

from __future__ import annotations

import datetime as dt
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from arcweave.schema import RELATIONS


def h(n: int) -> str:
    return f"{n:040d}"


def ident(kind: str, n: int) -> str:
    return f"swh:1:{kind}:{h(n)}"


URLS = ("https://example.com/swh/graph", "https://example.com/swh/graph2")
_FOO, _BAR, _BAZ = (f"{x}".encode() for x in ("foo", "bar", "baz"))


def relations(spark: SparkSession) -> dict[str, DataFrame]:
    at = lambda s: None if s is None else dt.datetime.fromtimestamp(s, dt.timezone.utc)
    e = lambda d, name, mode, kind, n: (h(d), name.encode(), kind, h(n), mode)
    file, run = 0o100644, 0o100755
    visit = dt.datetime(2013, 5, 7, 4, 20, 41, 369271, dt.timezone.utc)
    from hashlib import sha1

    branches = [(20, "refs/heads/master", 9, "revision"), (20, "refs/tags/v1.0", 10, "release"), (22, "refs/heads/master", 9, "revision"), (22, "refs/tags/v1.0", 10, "release"), (22, "refs/tags/v2.0-anonymous", 21, "release")]
    revs = [
        (3, 2, 1111122220, 120, 1111122220, 120, _FOO, _FOO, "Initial commit"), (9, 8, 1111144440, 120, 1111155550, 120, _BAR, _BAR, "Add parser"),
        (13, 12, 1111166660, 120, 1111166660, 120, _FOO, _BAR, "Add tests"), (18, 17, 1111177770, 0, 1111177770, 0, _BAZ, _FOO, "Refactor codebase"),
    ]
    rels = [(10, "v1.0", "Version 1.0", 9, _FOO, 1234567890, 120), (19, "v2.0", "Version 2.0", 18, _BAR, None, None), (21, "v2.0-anonymous", "Version 2.0 but with no author", 18, None, None, None)]
    rows = {
        "content": [(h(n), size) for n, size in ((1, 42), (4, 404), (5, 1337), (7, 666), (11, 313), (14, 14))],
        "skipped_content": [(h(15), 404)],
        "directory": [(h(n),) for n in (2, 6, 8, 12, 16, 17)],
        "directory_entry": [
            e(2, "README.md", file, "file", 1), e(6, "README.rst", file, "file", 4), e(6, "main.py", file, "file", 5), e(8, "README.md", file, "file", 1), e(8, "parser.c", file, "file", 7), e(8, "tests", run, "dir", 6),
            e(12, "README.md", file, "file", 11), e(12, "oldproject", run, "dir", 8), e(16, "TODO.txt", file, "file", 15), e(17, "TODO.txt", file, "file", 14), e(17, "old", run, "dir", 16),
        ],
        "revision": [(h(a), h(b), at(t), o, at(ct), co, au, c, m.encode()) for a, b, t, o, ct, co, au, c, m in revs],
        "revision_history": [(h(9), h(3)), (h(13), h(9)), (h(18), h(13))],
        "release": [(h(a), name.encode(), m.encode(), h(t), "revision", au, at(d), o) for a, name, m, t, au, d, o in rels],
        "snapshot": [(h(20),), (h(22),)],
        "snapshot_branch": [(h(s), n.encode(), h(t), k) for s, n, t, k in branches],
        "origin": [(sha1(u.encode()).hexdigest(), u) for u in URLS],
        "origin_visit_status": [(u, visit, "full", h(s), "git") for u, s in zip(URLS, (20, 22))],
        "person": [(x, sha256(x).digest()) for x in (_FOO, _BAR, _BAZ)],
    }
    return {name: spark.createDataFrame(rows[name], RELATIONS[name]) for name in RELATIONS}
