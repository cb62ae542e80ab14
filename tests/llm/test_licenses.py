import math
import re
import textwrap
from collections import Counter

from trackloom.llm import licenses as li
from trackloom.llm.queries import op10_license_scan


def brute(texts, threshold=0.6):
    """{id: best cosine of a line} over every line and template whose needed words it has, without markers and bounds."""
    counts = [(name, Counter(li.tokens(x))) for name, xs in li.TEMPLATES.items() for x in xs]
    owners = {}
    for name, c in counts:
        for t in c:
            owners.setdefault(t, set()).add(name)
    df = Counter(t for x in texts.values() for t in set(li.tokens(x or "")))
    idf = lambda t: 1 + math.log((1 + len(texts)) / (1 + df.get(t, 0)))

    def cosine(a, b):
        a, b = ({t: n * idf(t) for t, n in x.items()} for x in (a, b))
        size = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
        return sum(w * b.get(t, 0) for t, w in a.items()) / size if size else 0.0

    needed = [{t for t in c if re.search("[0-9]", t) or sum(c.values()) <= 12 and len(owners[t]) == 1} for _, c in counts]
    out = {}
    for d, text in texts.items():
        lines = [Counter(li.tokens(x)) for x in (text or "").split("\n")]
        out[d] = max((cosine(x, c) for x in lines for (_, c), need in zip(counts, needed) if need <= x.keys()), default=0.0)
    return out


def test_query_finds_every_line_a_full_search_finds(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: (r.license, r.score) for r in op10_license_scan(spark, small).collect()}
    want = brute(texts)
    assert got.keys() == want.keys()
    for d, best in want.items():
        if best >= 0.6:
            assert got[d][1] is not None and got[d][1] >= best - 1e-6
    fixed = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "GNU General Public License, version 3.": "GPL-3.0"}
    for d, t in texts.items():
        names = {name for line, name in fixed.items() if line in t}
        assert got[d][0] in (names or {None}), (d, got[d], names, t[-300:])


def test_inheritance_and_edges(spark):
    mit, apache, gpl = (max(li.TEMPLATES[k], key=len) for k in ("MIT", "Apache-2.0", "GPL-3.0"))
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/x.py", "plain text"), (3, "r/a/b/COPYING.txt", gpl), (4, "r/a/b/c/d/y.py", "more text"),
        (5, "r/a/b/z.py", f"# header\n{apache}\ncode"), (6, "s/x.py", "nothing"), (7, None, None), (8, "r", ""), (8, "r/a/x.py", "plain text"), (None, "r/ab/q", "text"),
        (9, "r/a/b/notes.txt", f"a story\nand {gpl[:60]}"),
    ]
    files = spark.createDataFrame([(i, p, t, "x", 1.0) for i, p, t in rows], "doc_id int, path string, text string, license string, score double")
    out = li.license_scan(files).collect()
    got = {(r.doc_id, r.path): (r.license, r.origin, r.license_dir) for r in out}
    assert len(out) == len(rows)
    assert got[2, "r/a/x.py"] == got[8, "r/a/x.py"] == got[None, "r/ab/q"] == ("MIT", "inherited", "r")
    assert got[4, "r/a/b/c/d/y.py"] == ("GPL-3.0", "inherited", "r/a/b")
    assert got[5, "r/a/b/z.py"] == ("Apache-2.0", "own", None)
    assert got[3, "r/a/b/COPYING.txt"][:2] == ("GPL-3.0", "own")
    assert got[6, "s/x.py"] == got[7, ""] == got[8, "r"] == (None, None, None)
    assert li.license_scan(files.limit(0)).count() == 0


def test_words_beside_a_notice_have_their_own_counts(spark):
    common = [f"en common words of module {i}" for i in range(300)]
    notices = ["en common Released under the MIT License.", "en words of module Licensed under the Apache License, Version 2.0.", "zyx vwu tsr qpo nml kji hgf edc baz yxw vut srq Released under the MIT License."]
    texts = dict(enumerate(common + notices))
    df = Counter(t for x in texts.values() for t in set(li.tokens(x)))
    idf = lambda t: 1 + math.log((1 + len(texts)) / (1 + df.get(t, 0)))

    def cosine(a, b):
        a, b = ({t: n * idf(t) for t, n in Counter(li.tokens(x)).items()} for x in (a, b))
        return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    files = spark.createDataFrame([(i, "", t) for i, t in texts.items()], "doc_id int, path string, text string").repartition(3)
    got = {r.doc_id: (r.license, r.score) for r in li.license_scan(files).collect()}
    assert [got[300 + i][0] for i in range(3)] == ["MIT", "Apache-2.0", None] and all(got[i][0] is None for i in range(300))
    for i, t in enumerate(notices[:2]):
        assert abs(got[300 + i][1] - max(cosine(t, x) for xs in li.TEMPLATES.values() for x in xs)) < 1e-9


def test_each_license_line_of_documents_is_found(spark):
    sf = "/root/testdata/sf0.01"
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.license for r in op10_license_scan(spark, sf).collect()}
    want = {d: {name for line, name in lines.items() if line in t} for d, t in texts.items()}
    assert set().union(*want.values()) == set(lines.values())
    assert not [(d, names, got[d]) for d, names in want.items() if (got[d] not in names if names else got[d] is not None)]
    own = spark.createDataFrame([(name, "", x) for name, xs in li.TEMPLATES.items() for x in xs], "doc_id string, path string, text string")
    assert all(r.license == r.doc_id for r in li.license_scan(own).collect())


def test_versions_tags_and_wrapped_notices(spark):
    """Every long notice wrapped at several widths in a file, tags, other spellings of versions, and tags of no known license."""
    code = "\n".join(f"int value_{i} = compute({i});" for i in range(40))
    rows = []
    for name, xs in li.TEMPLATES.items():
        for width in (30, 50, 72):
            body = textwrap.wrap(max(xs, key=len), width, break_on_hyphens=False, break_long_words=False)
            rows.append((name, "\n".join(f" * {x}" for x in body) if width > 30 else "\n".join(body)))
        rows.append((name, f"# {li.TAG.format(name)}"))
    rows += [("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"), ("LGPL-2.1", "// SPDX-License-Identifier: LGPL-2.1-or-later"), ("Apache-2.0", "Licensed under the Apache License v2"), ("GPL-3.0", "This work is licensed under the GNU General Public License v3.0")]
    none = ["SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: GPL-1.0-only", "Licensed under the BSD 4-Clause License.", "the MIT campus, version 3"]
    texts = [(i, "", f"{code}\n{t}\n{code}") for i, (_, t) in enumerate(rows)] + [(1000 + i, "", f"{code}\n{t}\n{code}") for i, t in enumerate(none)]
    out = {r.doc_id: r for r in li.license_scan(spark.createDataFrame(texts, "doc_id int, path string, text string").repartition(3)).collect()}
    wrong = [(name, t[:60], out[i].license, out[i].score) for i, (name, t) in enumerate(rows) if out[i].license != name or out[i].score < 0.85 or out[i].margin <= 0]
    assert not wrong, wrong
    assert not [out[1000 + i] for i in range(len(none)) if out[1000 + i].license]


def test_a_very_long_file(spark):
    text = "\n".join(f"line {i} of a long file with some words" for i in range(60_000)) + "\nReleased under the MIT License.\n" + "x" * 2_000_000
    files = spark.createDataFrame([(1, "a/b", text), (1, "a/b", text)], "doc_id int, path string, text string")
    assert [(r.license, r.first_line) for r in li.license_scan(files).collect()] == [("MIT", 60_000)] * 2
