import random
import re

from chunkloom.llm import licenses, rollups

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text):
    w = words(text)
    at, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base))


def test_against_brute_force(spark, edge):
    r = random.Random(5)
    pool = "apache license mit gnu general public cc by BY Licensed the of and foo bar".split()
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 200, 900])))) for i in range(120)]
    rows += [(200, "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"), (201, "x " * 63 + "gnu general public license " + "y " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for i, text in rows:
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute(text), text
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert "apache-text" in got[200]["labels"]
    out = licenses.license_scan(edge).collect()
    assert len(out) == edge.count() and {r["doc_id"]: r["base_labels"] for r in out}[12] == "apache,cc-by,mit"
    assert licenses.license_scan(edge.limit(0)).count() == 0


def test_every_block_that_contains_a_template_is_found():
    t = licenses.default_templates()
    m = licenses.Matcher(t, {}, 256)
    r = random.Random(9)
    tokens = sorted(set().union(*(x.tokens for x in t)))
    for _ in range(2000):
        block = frozenset(r.sample(tokens, r.randint(1, 40)))
        want = {i for i, x in enumerate(t) if len(x.tokens & block) >= x.need}
        assert {i for i, _ in m.contained(block)} == want


def brute_labels(w, templates):
    """Labels and score by plain sets over all blocks of a template's class."""
    labels, score = set(), 0.0
    for t in templates:
        reach = 32
        while reach < len(t.words):
            reach *= 2
        for start in range(0, len(w), 2 * reach):
            part = w[start : start + 3 * reach - 1]
            if t.phrase:
                if any(w[i : i + len(t.words)] == t.words for i in range(start, min(start + 2 * reach, len(w)))):
                    labels.add(t.label)
                    score = 1.0
                continue
            share = len(set(part) & t.tokens) / len(t.tokens)
            if len(set(part) & t.tokens) >= t.need:
                labels.add(t.label)
                score = max(score, share)
    return labels, score


def test_labels_and_score_against_brute_force(spark):
    r = random.Random(8)
    templates = licenses.default_templates()
    rows = []
    for i in range(150):
        w = [f"x{r.randrange(50)}" for _ in range(r.choice([0, 10, 70, 300, 700]))]
        for _ in range(r.randint(0, 2)):
            t = [x.decode() for x in r.choice(templates).words]
            for _ in range(r.randint(0, len(t) // 4)):
                t[r.randrange(len(t))] = r.choice(["the", "license", "zz"])
            at = r.randint(0, len(w))
            w[at:at] = t
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x for x in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    hits = 0
    for i, text in rows:
        labels, score = brute_labels([x.encode() for x in words(text)], templates)
        assert (got[i]["labels"], got[i]["score"]) == (",".join(sorted(labels)), score), text
        hits += any(x.endswith("-full") for x in labels)
    assert hits > 5


def test_long_templates_at_every_offset(spark):
    text = " ".join(f"t{i}" for i in range(150))
    table = spark.createDataFrame([(text, "long", 0.8, 1), ("a few words of another one", "short", None, 2), (None, "none", 0.5, 3)], "text string, label string, threshold double, n int")
    rows = [(k, "x " * k + text + " y" * 40) for k in range(0, 600, 7)] + [(1000, text.rpartition(" t100 ")[0])]
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=table).collect()}
    assert all(v == "long" for k, v in got.items() if k < 1000) and got[1000] == ""
    for bad in ("", "!!!"):
        try:
            licenses.Template(licenses.words_of(bad), "x", 1.0, False)
            raise AssertionError
        except ValueError:
            pass


def test_batches_stay_known_after_many_compactions(spark, tmp_path):
    docs = spark.createDataFrame([("a b c", "s", "en"), ("d", "s", "en")], "text string, source string, lang string")
    r = rollups.Rollup(spark, f"file://{tmp_path}/roll")
    one = rollups.changes(docs, "words-1")
    for k in range(1, 5):
        assert r.commit(f"b{k}", one)
        r.compact(f"c{k}")
        r.compact(f"c{k}")  # again: nothing
        for j in range(1, k + 1):
            assert not r.commit(f"b{j}", one)
        assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "words-1", 2 * k, 4 * k)]
    assert r._live() == ["compacted-c4"]
    try:
        r.commit("compacted-x", one)
        raise AssertionError
    except ValueError:
        pass


def test_compaction_that_failed_half_way(spark, tmp_path):
    docs = spark.createDataFrame([("a b c", "s", "en")], "text string, source string, lang string")
    r = rollups.Rollup(spark, f"file://{tmp_path}/roll")
    one = rollups.changes(docs, "words-1")
    r.commit("b1", one)
    spark.createDataFrame([("b1",)], "name string").write.parquet(f"{tmp_path}/roll/names-compacted-c1")  # names, no sums
    assert r.totals().first()["n_tokens"] == 3
    r.compact("c1")
    spark.read.parquet(f"{tmp_path}/roll/batch=compacted-c1").write.parquet(f"{tmp_path}/roll/batch=b1")  # the folder is still there
    assert r.totals().first()["n_tokens"] == 3 and not r.commit("b1", one)
    r.compact("c2")
    assert r.totals().first()["n_tokens"] == 3 and r._live() == ["compacted-c2"]


def test_rollup(spark, edge, tmp_path):
    r = rollups.Rollup(spark, f"file://{tmp_path}/roll")
    assert r.totals().count() == 0
    one = rollups.changes(edge, "words-1")
    assert r.commit("b1", one) and not r.commit("b1", one)
    first = sorted(map(tuple, r.totals().collect()), key=repr)
    n = {}
    for d in edge.collect():
        k = (d.source, d.lang, "words-1")
        a, b = n.get(k, (0, 0))
        n[k] = (a + 1, b + len((d.text or "").encode().split()))
    assert first == sorted(((*k, *v) for k, v in n.items()), key=repr)
    assert r.commit("empty", one.limit(0))
    assert r.commit("gone", rollups.changes(edge, "words-1", -1)) and r.totals().count() == 0
    from pyspark.sql import functions as F

    assert r.commit("again", one) and r.commit("revised", rollups.revisions(edge.where("doc_id = 6"), F.lit(1), F.lit(4), "words-1"))
    after = {tuple(x)[:3]: x["n_tokens"] for x in r.totals().collect()}
    assert after[("s1", None, "words-1")] == n[("s1", None, "words-1")][1] + 3
    before = sorted(map(tuple, r.totals().collect()), key=repr)
    r.compact("c1")
    assert sorted(map(tuple, r.totals().collect()), key=repr) == before
    assert not r.commit("b1", one) and sorted(map(tuple, r.totals().collect()), key=repr) == before
