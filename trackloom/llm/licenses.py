"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.scratch import stored

#: Notices by which licenses are declared, by their public names.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-NC-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."],
    "CC-BY-3.0": ["This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "Licensed under CC BY 3.0."],
    "CC-BY-SA-3.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "Licensed under CC BY-SA 3.0."],
    "CC-BY-NC-3.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.", "Licensed under CC BY-NC 3.0."],
    "CC-BY-ND-3.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 Unported License.", "Licensed under CC BY-ND 3.0."],
    "CC-BY-NC-SA-3.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "Licensed under CC BY-NC-SA 3.0."],
    "CC-BY-NC-ND-3.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License.", "Licensed under CC BY-NC-ND 3.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work. Creative Commons CC0 1.0 Universal public domain dedication."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: The notice of the GNU licenses, and for each its work, name and version; tags by which files declare a license.
GNU_NOTICE = "This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
GNU = {
    "GPL-2.0": ("program", "GNU General Public License", "2"),
    "GPL-3.0": ("program", "GNU General Public License", "3"),
    "AGPL-3.0": ("program", "GNU Affero General Public License", "3"),
    "LGPL-2.1": ("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("library", "GNU Lesser General Public License", "3"),
}
TAG = "SPDX-License-Identifier: {}"
for _name, _texts in TEMPLATES.items():
    if _name in GNU:
        _work, _license, _version = GNU[_name]
        _texts.append(GNU_NOTICE.format(work=_work, name=_license, version=_version))
    _texts += [TAG.format(x) for x in ([_name, f"{_name}-only", f"{_name}-or-later"] if _name in GNU else [_name])]
#: Fixed value: names of the files that license their directory.
LICENSE_FILE = re.compile(r"(?:un)?licen[cs]e(?:[._-].*)?|copying(?:[._-].*)?", re.I)

TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
VERSION = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)?")
#: A template of no more words than this needs all words that only its license has.
SHORT = 12
#: Lines between marked ones that a stretch may hold, and the share of a line's words in the template from which the stretch takes it in.
BRIDGED, ALIKE = 3, 0.7
HOT_SHARE = 1000
#: Different words that a task counts before it hands them on.
COUNTED = 100_000

SEGMENT = pa.struct([("first_line", pa.int32()), ("end_line", pa.int32()), ("license", pa.string()), ("dot", pa.float64()), ("next_dot", pa.float64()), ("squares", pa.float64()), ("words", pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())])))])


def tokens(text: str) -> list[str]:
    """Words in lower case; versions without a leading v and a trailing .0, so that v2, 2 and 2.0 are one word."""
    found = TOKEN.findall(text.lower())
    return [m[1] if w[-1].isdigit() and (m := VERSION.fullmatch(w)) else w for w in found]


class Index:
    """Unit vectors of the templates, the words each needs, and the terms without which no text can reach the threshold."""

    def __init__(self, templates: dict, found: dict, documents: int, threshold: float):
        self.threshold = threshold
        self.idf = {t: 1 + math.log((1 + documents) / (1 + n)) for t, n in found.items()}
        counts = [(name, Counter(tokens(x))) for name in sorted(templates) for x in templates[name]]
        self.vectors = [(name, self.vector(c)) for name, c in counts]
        owners: dict[str, set] = {}
        for name, c in counts:
            for t in c:
                owners.setdefault(t, set()).add(name)
        # versions must agree, and a short notice or tag must have the words of its license alone
        self.needed = [{t for t in c if any(x.isdigit() for x in t) or sum(c.values()) <= SHORT and len(owners[t]) == 1} for _, c in counts]
        # by Cauchy and Schwarz a text's cosine is at most the length of the template's part that it shares terms with:
        # the rarest terms are markers until the rest of every template is shorter than the threshold
        self.markers: set[str] = set()
        for _, v in self.vectors:
            left = 1.0
            for term in sorted(v, key=lambda t: (-self.idf[t], t)):
                if math.sqrt(max(left, 0)) < threshold - 1e-9:
                    break
                self.markers.add(term)
                left -= v[term] ** 2

    def vector(self, counts: Counter) -> dict:
        weights = {t: n * self.idf[t] for t, n in counts.items()}
        size = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / size for t, w in weights.items()} if size else {}

    def nearest(self, counts: Counter, complete: bool = True) -> tuple[int | None, float, float]:
        """(template, dot, dot of the nearest other license) of the templates whose needed words are there (or of all), the first by name of equals."""
        own = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
        best: dict[str, tuple[float, int]] = {}
        for k, (name, v) in enumerate(self.vectors):
            if not complete or self.needed[k] <= own.keys():
                dot = sum(w * own.get(t, 0.0) for t, w in v.items())
                if dot > best.get(name, (0.0, k))[0]:
                    best[name] = (dot, k)
        order = sorted(best.items(), key=lambda x: (-round(x[1][0], 9), x[0]))
        return (order[0][1][1], order[0][1][0], order[1][1][0] if len(order) > 1 else 0.0) if order else (None, 0.0, 0.0)

    def segment(self, first: int, end: int, counts: Counter) -> dict | None:
        """What a segment's cosine is made of, or None where no counts of its other words could lift it to the threshold.

        The cosine is dot over the root of squares and of the squared weights of
        words, those of counts that are in no template; a word's idf is 1 at
        least, that of a word in every text.
        """
        k, dot, following = self.nearest(counts)
        squares = sum((n * self.idf[t]) ** 2 for t, n in counts.items() if t in self.idf)
        words = [(t, n) for t, n in counts.items() if t not in self.idf]
        if k is None or not dot or dot / math.sqrt(squares + sum(n * n for _, n in words)) < self.threshold - 1e-9:
            return None
        return {"first_line": first, "end_line": end, "license": self.vectors[k][0], "dot": dot, "next_dot": following, "squares": squares, "words": [{"term": t, "n": n} for t, n in words]}


def stretches(lines: list[list[str]], marked: list[int], index: Index) -> set[tuple[int, int]]:
    """Runs of marked lines, with no and with up to BRIDGED lines between, the latter also with what is around them of the template they are nearest to."""
    found = set()
    for bridged in (0, BRIDGED):
        cuts = [k for k in range(1, len(marked)) if marked[k] > marked[k - 1] + 1 + bridged]
        for a, b in zip([0, *cuts], [*cuts, len(marked)]):
            first, end = marked[a], marked[b - 1] + 1
            found.add((first, end))
            k = index.nearest(Counter(w for words in lines[first:end] for w in words), False)[0] if bridged else None
            if k is not None:
                known = index.vectors[k][1]
                alike = lambda words: sum(w in known for w in words) >= ALIKE * len(words)  # noqa: E731  also for lines without words
                while first and alike(lines[first - 1]):
                    first -= 1
                while end < len(lines) and alike(lines[end]):
                    end += 1
                found.add((first, end))
    return found


def possible_segments(text: str, index: Index) -> list[dict]:
    """Each line with a marker, each stretch of such lines, and the whole text, where they may reach the threshold.

    Lines without a marker can't reach it alone.
    """
    lines = [tokens(x) for x in text.split("\n")]
    marked = [i for i, words in enumerate(lines) if not index.markers.isdisjoint(words)]
    if not marked:
        return []
    spans = {(i, i + 1) for i in marked} | stretches(lines, marked, index) | {(0, len(lines))}
    found = (index.segment(a, b, Counter(w for words in lines[a:b] for w in words)) for a, b in sorted(spans))
    return [x for x in found if x]


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """term, n: in how many texts each word occurs, over all rows; the term "" has the number of rows."""

    def count(batches):
        found, rows = Counter(), 0

        def counted():
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])
            found.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                found.update(set(tokens(text or "")))
                if len(found) >= COUNTED:
                    yield from counted()
        found[""] = rows
        yield from counted()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _scored(segments: DataFrame, words: DataFrame, rows: int, threshold: float) -> DataFrame:
    """rid, best (license, score, first_line, end_line): a row's segment of the largest cosine, the first of equals, if it reaches threshold."""
    place = ["rid", "first_line", "end_line"]
    found = segments.select("rid", F.explode("segments").alias("s")).select("rid", "s.*")
    used = found.select(*place, F.explode("words").alias("w")).select(*place, "w.*")
    idf = 1 + F.log(F.lit(1.0 + rows) / (1 + F.col("texts")))
    known = used.groupBy("term").agg(F.count("*").alias("uses")).join(words.select("term", F.col("n").alias("texts")), "term").select("term", "uses", idf.alias("idf"))
    known = stored(known, "idf")
    bound = max(HOT_SHARE, (known.agg(F.sum("uses")).first()[0] or 0) // HOT_SHARE)
    hot, rest = F.broadcast(known.where(F.col("uses") > bound)), known.where(F.col("uses") <= bound)
    weighed = used.join(hot, "term").unionByName(used.join(hot.select("term"), "term", "left_anti").join(rest, "term"))
    others = weighed.groupBy(*place).agg(F.sum(F.pow(F.col("n") * F.col("idf"), 2)).alias("more"))
    size = F.sqrt(F.col("squares") + F.coalesce("more", F.lit(0.0)))
    scored = found.join(others, place, "left").withColumns({"score": F.col("dot") / size, "margin": (F.col("dot") - F.col("next_dot")) / size}).where(F.col("score") >= threshold)
    return scored.groupBy("rid").agg(F.min_by(F.struct("license", "score", "margin", "first_line", "end_line"), F.struct(-F.round("score", 9), "first_line", "end_line")).alias("best"))


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """One row per input row: doc_id, path, license, score, margin, first_line, end_line, origin, license_dir.

    The best segment of a whole text (a line, a stretch of lines or all of it)
    gives its own license if the cosine of its TF-IDF vector to a template
    reaches threshold; document frequencies are those of all words over all
    rows.  A template counts only where its version is, short notices and tags
    only with the words that none but their license has; margin is how far the
    cosine is above that of the nearest other license.  A file
    named like a license file whose text has one licenses its directory; where
    a directory has several, the highest cosine, then the first name counts.  A
    row without its own license takes that of the nearest such directory above
    it (origin "inherited"); others have null license and origin.  A null text
    or path is empty; an empty path has only the root above it.  Rows with
    equal ids or paths are scanned each by itself; other columns are ignored;
    an empty table gives an empty result.

    Directories, not files, meet their ancestors; a directory with many files
    joins back by broadcast (fewer than HOT_SHARE hold more than 1/HOT_SHARE).
    """
    terms = {t for texts in templates.values() for x in texts for t in tokens(x)}
    words = stored(word_counts(files, text_col), "words")
    found = {r["term"]: r["n"] for r in words.where(F.col("term").isin("", *terms)).collect()}
    rows = found.pop("", 0)
    found = {t: found.get(t, 0) for t in terms}
    shared = files.sparkSession.sparkContext.broadcast((templates, found, rows, threshold))
    own = files.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        index = Index(*shared.value)
        for batch in batches:
            possible = [possible_segments(t, index) if t else [] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(possible, pa.list_(SEGMENT))], ["doc_id", "path", "segments"])

    scanned = own.mapInArrow(scan, f"doc_id {kind}, path string, segments array<struct<first_line:int,end_line:int,license:string,dot:double,next_dot:double,squares:double,words:array<struct<term:string,n:bigint>>>>")
    scanned = stored(scanned.withColumn("rid", F.monotonically_increasing_id()), "segments")
    some, none = scanned.where(F.size("segments") > 0), scanned.where(F.size("segments") == 0)
    best = stored(_scored(some, words, rows, threshold), "best")
    scanned = some.join(best, "rid", "left").select("doc_id", "path", "best.*").unionByName(none.select("doc_id", "path"), allowMissingColumns=True)
    names = F.col("license").isNotNull() & F.regexp_extract("path", "[^/]*$", 0).rlike(f"(?is)^(?:{LICENSE_FILE.pattern})\\z")
    scanned = stored(scanned.withColumns({"licenses_dir": names, "dir": F.regexp_replace("path", "/?[^/]*$", "")}), "licenses")
    licensed = scanned.where("licenses_dir").groupBy(F.col("dir").alias("license_dir")).agg(F.min_by("license", F.struct(-F.round("score", 9), "license")).alias("dir_license"))
    dirs = scanned.groupBy("dir").agg(F.count("*").alias("files"))
    parts = F.split("dir", "/")
    above = dirs.select("dir", "files", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth"), parts.alias("parts"))
    above = above.select("dir", "files", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("license_dir"))
    nearest = above.join(licensed, "license_dir").groupBy("dir").agg(F.max_by(F.struct("license_dir", "dir_license"), "depth").alias("near"), F.first("files").alias("files"))
    nearest = stored(nearest, "nearest")
    bound = max(HOT_SHARE, scanned.count() // HOT_SHARE)
    hot, rest = F.broadcast(nearest.where(F.col("files") > bound)), nearest.where(F.col("files") <= bound)
    joined = scanned.join(hot, "dir").unionByName(scanned.join(hot.select("dir"), "dir", "left_anti").join(rest, "dir", "left"))
    inherits = F.col("license").isNull() & F.col("near").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("license", "near.dir_license").alias("license"),
        "score",
        "margin",
        "first_line",
        "end_line",
        F.when(F.col("license").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("near.license_dir")).alias("license_dir"),
    )
