import hashlib
import re

from tidewell.llm.decontaminate import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    owners = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in owners}:
            for k in range(len(w) - n + 1):
                if o := owners.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= o
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(docs, items, **kw):
    rows = decontaminate(docs, items, **kw).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)


def test_matches_brute_force(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert run(docs, items) == want and any(w[-1] for w in want)
    # items in many parts, and an index of all words, give the same
    assert run(docs, items, item_bytes=700, vocabulary_bytes=50) == want


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "WORD"), (2, None), (3, ""), (4, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (5, "x-y z"), (6, "word"), (7, "123 abc")], "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert run(odd_docs, items) == want
    assert [r[3] for r in want if r[0] == 5] == [2]
    assert run(no_docs, items) == []
    assert not any(r[-1] for r in run(odd_docs, items.limit(0)))


def test_proximity(spark):
    body = "one two three four five six seven eight nine ten eleven twelve"
    shuffled = "zero eleven then twelve and seven near eight end"
    docs = spark.createDataFrame([(1, shuffled), (2, "seven " + "gap " * 200 + "eight eleven twelve")], "doc_id long, text string")
    items = spark.createDataFrame([(9, body)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert rows[1].near_items == ["9"] and not rows[1].contaminated and rows[2].near_items == []


def test_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x y z"), (3, None)], "item_id long, text string")
    for item_bytes, passes in ((1 << 20, 1), (1, 2)):
        found = decontaminate(docs, items, item_bytes=item_bytes)
        # a second one in the stage would stay in the executor beside every later stage's workers
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1, passes
        assert [(r.doc_id, r["items"]) for r in found.orderBy("doc_id").collect()] == [(1, ["1"]), (2, ["2"])]
