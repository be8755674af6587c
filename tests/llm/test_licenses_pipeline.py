import math
import os
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import decontaminate, jaccard, packing, quality, toxicity
from tidewell.llm import licenses as M

WORD = re.compile(r"[0-9]+(?:\.[0-9]+)+|[^\W_]+")


def vector(text, idf, rare):
    w = {t: (1 + math.log(c)) * idf.get(t, rare) for t, c in Counter(WORD.findall(text.lower())).items()}
    n = math.sqrt(sum(x * x for x in w.values())) or 1
    return {t: x / n for t, x in w.items()}


def brute_passages(text, known):
    plain = re.sub(r"([.!?])[ \t]+", r"\1\n", text.translate({1: " ", 2: " "}))
    cut = [(x, WORD.findall(x.lower())) for x in re.split(r"[\r\n]+", plain)]
    like = [x if sum(t in known for t in w) >= M.SHARE * len(w) else None for x, w in cut if w]
    runs, run = [], []
    for x in [*like, None]:
        if x is not None:
            run.append(x)
        elif run:
            runs.append(run)
            run = []
    out = {" ".join(r[i : i + n]) for r in runs for n in (*M.WINDOWS, len(r)) for i in range(len(r) - n + 1)}
    n = sum(x is not None for x in like)
    return out | ({text} if n and 2 * n >= len(like) else set())


def brute_own(text):
    n = len(M.TEMPLATES)
    df = Counter(t for _, body in M.TEMPLATES for t in set(WORD.findall(body.lower())))
    idf, rare = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}, math.log(1 + n) + 1
    vectors = [vector(body, idf, rare) for _, body in M.TEMPLATES]
    best = 0.0
    for p in brute_passages(text or "", df):
        v = vector(p, idf, rare)
        best = max(best, *(sum(x * t.get(w, 0) for w, x in v.items()) for t in vectors))
    return best


def test_scores_match_brute_force(spark, docs):
    files = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    extra = spark.createDataFrame([(f"t/{i}", f"intro\n{body[:300]}\nrest of it") for i, (_, body) in enumerate(M.TEMPLATES)], "path string, text string")
    files = files.unionByName(extra)
    texts = {r.path: r.text for r in files.collect()}
    rows = M.scan(files).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_own(texts[r.path])
        assert (r.origin == "own") == (want >= M.THRESHOLD) and (r.origin != "own" or abs(r.score - want) < 1e-6)


def test_wrapped_headers_among_code(spark):
    code = "\n".join(f"def f{i}(x{i}, y{i}):  # z{i}\n    return g{i}(x{i})[y{i}]" for i in range(30))
    rows, want = [], {}
    for license, body in (("MPL-2.0", "Mozilla Public License, v. 2.0"), ("Unlicense", "free and unencumbered"), ("GPL-3.0", "either version 3"), ("MIT", "furnished to do so"), ("ISC", "Permission to use, copy, modify, and/or")):
        notice = next(t for i, t in M.NOTICES if i == license and body in t)
        for width, sign in ((76, "# "), (60, " * "), (40, "// ")):
            path = f"{license}-{width}/a.c"
            header = "\n".join(sign + x for x in textwrap.wrap(notice, width))
            rows.append((path, f"{sign}Copyright 2021 Jane Q. Roe\n{sign}\n{header}\n\n{code}"))
            want[path] = license
    got = {r.path: r for r in M.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: r.license for p, r in got.items()} == want and all(r.origin == "own" for r in got.values())


def test_very_long_text(spark):
    rows = [("a", "lorem ipsum dolor " * 200_000), ("b", "lorem ipsum\n" * 50_000 + "Released under the MIT License.\n" + "dolor sit\n" * 50_000)]
    assert {r.path: r.license for r in M.scan(spark.createDataFrame(rows, "path string, text string")).collect()} == {"a": None, "b": "MIT"}


def test_nearest_directory_speaks(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("LICENSE", gpl), ("a/LICENSE.txt", mit), ("a/b/c/x.py", "x"), ("a/b/c/x.py", "x"), ("b/y.py", None), ("a2/z.py", ""), ("a/own.py", f"# {gpl}\ncode " + "word " * 50), ("a/b/NOTICE", "nothing here"), (None, gpl), (None, None)]
    got = {(r.path, r.origin, r.license, r.licensed_by) for r in M.scan(spark.createDataFrame(rows, "path string, text string").withColumn("file", F.lit("clash")).withColumn("dir", F.lit("clash"))).collect()}
    assert got == {
        ("LICENSE", "own", "GPL-3.0", None), ("a/LICENSE.txt", "own", "MIT", None), ("a/b/c/x.py", "inherited", "MIT", "a"), ("b/y.py", "inherited", "GPL-3.0", ""), ("a2/z.py", "inherited", "GPL-3.0", ""),
        ("a/own.py", "own", "GPL-3.0", None), ("a/b/NOTICE", "inherited", "MIT", "a"), (None, "own", "GPL-3.0", None), (None, "none", None, None),
    }
    assert M.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_spdx_lines_and_full_texts(spark):
    full = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "CC0-1.0": "CC0-1.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    lines = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD-3-Clause", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LicenseRef-Acme": None}
    rows, want = [], {}
    for name, license in full.items():
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            rows += [(f"{name}/LICENSE", "Copyright 2020 A. Person\n\n" + f.read()), (f"{name}/src/a.py", "x = 1")]
        want |= {f"{name}/LICENSE": (license, "own"), f"{name}/src/a.py": (license, "inherited")}
    for i, (name, license) in enumerate(lines.items()):
        rows.append((f"s/{i}.py", f"# SPDX-License-Identifier: {name}\nimport os\nprint(os.name)\n"))
        want[f"s/{i}.py"] = (license, "own" if license else "none")
    got = {r.path: (r.license, r.origin) for r in M.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want


def test_pipeline_matches_its_parts(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids, texts = list(rows), [t.encode() for t in rows.values()]
    frame = lambda keep: docs.where(F.col("doc_id").isin(*keep))
    model = quality.fit(docs, labels)
    keep = [i for i, s in zip(ids, model.scores(texts), strict=True) if s >= 0.5]
    index = toxicity.fit(frame(keep), labels)
    keep = [i for i in keep if index.score(rows[i].encode())[0] < 0.7]
    alone = {r.doc_id for r in jaccard.jaccard_components(frame(keep), 5, (80, 100)).collect() if r.doc_id == r.component_id}
    keep = [i for i in keep if i in alone]
    dirty = {r.doc_id for r in decontaminate.decontaminate(frame(keep), items).collect() if r.contaminated}
    keep = [i for i in keep if i not in dirty]
    got = corpus_pipeline.run(spark, sf)
    want = packing.pack(frame(keep))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and 0 < got.count() < len(ids)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    sf = "/root/testdata/sf0.001"
    odd = odd_docs.withColumns({corpus_pipeline.QUALITY: F.lit(1.0), "_c_": F.lit(1), "component_id": F.lit(1), "h": F.lit(2), "block": F.lit(3)}).drop(corpus_pipeline.QUALITY)
    rows = corpus_pipeline.keep_one_of_each(spark, odd, sf)
    assert rows.columns == odd.columns
    got = sorted((r.doc_id, (r.text or "")[:5]) for r in rows.collect())
    # copies that share an id, or have none, leave one row
    assert got == [(1, "alpha"), (2, ""), (3, ""), (4, " \t\n "), (5, "word"), (7, "lorem"), (8, "Ünïcö"), (9, "x y z")]
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    clean = corpus_pipeline.keep_uncontaminated(spark, odd, str(tmp_path / "sf")).collect()
    assert len(clean) == 9 and not any((r.text or "").startswith("alpha") for r in clean)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0, name
    odd_docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (5, None, 1), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() <= 12
