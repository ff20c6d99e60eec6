import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_duplicates import expected_words, shingles

import __spark_entry__


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps, kept = [f for _, f in corpus_pipeline.STAGES], [docs]
    assert len(steps) == 5
    for k, f in enumerate(steps):
        f(spark, kept[-1], sf).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert kept[-1].columns == docs.columns
    tables = [t.collect() for t in kept]
    # classifier: documents labelled good stay
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()} & {r["doc_id"] for r in tables[0]}
    stay = {r["doc_id"] for r in tables[1]}
    assert len(good & stay) >= 0.95 * len(good) and len(stay) < len(tables[0])
    # Jaccard join: one document of each class
    rows = sorted((r["doc_id"], r["text"]) for r in tables[1])
    sets, up = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}
    find = lambda x: x if up[x] == x else find(up[x])
    for i, _ in rows:
        for j, _ in rows:
            k = len(sets[i] & sets[j])
            if j < i and k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                up[max(find(i), find(j))] = min(find(i), find(j))
    assert {r["doc_id"] for r in tables[2]} == {d for d, _ in rows if find(d) == d}
    # substring dedup
    lost = {r[0]: r[2] for r in expected_words([(r["doc_id"], r["text"]) for r in tables[2]])}
    before = {r["doc_id"]: r["text"] for r in tables[2]}
    for r in tables[3]:
        assert len(r["text"].encode().split()) == len(before[r["doc_id"]].encode().split()) - lost[r["doc_id"]]
        assert lost[r["doc_id"]] or r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    # mixing and encoding
    assert len(tables[4]) == len(tables[5]) and {r["doc_id"] for r in tables[4]} <= {r["doc_id"] for r in tables[3]}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in tables[4]}
    assert all(r["ids"] == sp.encode(text[r["doc_id"]], add_eos=True) for r in tables[5])


def test_registered():
    q = __spark_entry__.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{i}_") for n in q) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(q)


def test_stages_on_edges(spark, edge, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing columns, and empty tables."""
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1), (2, 1), (4, 0), (None, 1), (8, None)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    for docs in (edge, edge.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, sf)
            if f is not corpus_pipeline.encode_pieces:
                assert out.columns == docs.columns, name
            assert (out.count() == 0) == (docs is not edge), name
    docs = [(r["doc_id"], r["text"], r["node"], r["score"]) for r in edge.collect()]
    kept = [(r["doc_id"], r["text"], r["node"], r["score"]) for r in corpus_pipeline.join_near_duplicates(spark, edge, sf).collect()]
    assert set(kept) <= set(docs) and sorted(d for d, *_ in kept if d) == [1, 3, 4, 5, 6, 8, 10, 11, 12] and None in {d for d, *_ in kept}
    cleaned = corpus_pipeline.remove_substrings(spark, edge, sf).collect()
    assert len(cleaned) == len(docs) and all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in cleaned)
    encoded = corpus_pipeline.encode_pieces(spark, edge, sf).collect()
    assert len(encoded) == len(docs) and all(r["n_tokens"] == len(r["ids"]) and r["is_lossless"] for r in encoded)


def test_mix_of_rows_with_one_id(spark):
    rows = [(1, "a " * 40, "s"), (1, "b " * 3, "t"), (None, "c " * 9, "s"), (None, "d " * 2, None), (2, "e " * 70, "t"), (3, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from chunkloom.llm import mixing

    want = {(g["doc_id"], g["size"], g["source"]): g["copies"] for g in mixing.mix(docs).collect()}
    got = {}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        k = (r["doc_id"], len((r["text"] or "").split()), r["source"])
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_near_duplicates_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(400)]
    a, b, c = (" ".join(words[i : i + 100]) for i in (0, 100, 200))
    near = a + " more"
    rows = [(1, a, "x"), (2, near, "x"), (2, b, "x"), (3, c, "x"), (3, c, "y"), (None, a, "x"), (4, "", "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.join_near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (None, a), (4, ""), (4, "")], key=repr)
