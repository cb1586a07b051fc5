from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelode.text import context, embed, retrieval, search
from pricelode.text.chunk import WHITESPACE, chunk_documents
from pricelode.text.index import load_index
from registry.queries import QUERIES


def expected_chunks(doc_id, text, size=400, overlap=80):
    text, out = text.strip(), []
    for start in range(0, len(text), size - overlap):
        piece = text[start:start + size].strip()
        if piece:
            out.append((hashlib.sha256(f"{doc_id}-{len(out)}".encode()).hexdigest()[:12], piece))
    return out


TEXTS = {
    "empty": "", "blank": " \n\t ", "short": "Short text.", "400": "a" * 400, "401": "b" * 401, "720": "c" * 720,
    "721": "d" * 721, "hole": "x" * 320 + " " * 500 + "y" * 300, "edges": "   padded   ",
    "unicode": "é漢字🙂 " * 700, "long": "word " * 20_000, "none": None,
}


def test_chunks_equal_the_plain_loop(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id string, content string")
    got = {}
    for r in chunk_documents(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_id"], r["text"]))
    want = {d: expected_chunks(d, t or "") for d, t in TEXTS.items()}
    assert got == {d: c for d, c in want.items() if c}


def test_overlap_and_metadata(spark):
    df = spark.createDataFrame([("d3", "a" * 50 + "b" * 150, "T", 7)], "doc_id string, content string, title string, n int")
    chunks = chunk_documents(df, size=100, overlap=20).orderBy("chunk_index").collect()
    assert chunks[0]["text"][-20:] == chunks[1]["text"][:20]
    assert chunks[0]["metadata"] == {"title": "T", "n": "7"}
    with pytest.raises(ValueError):
        chunk_documents(df, size=50, overlap=50)


def test_white_space_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(0).normal(size=(20, 64)).astype(np.float32)
    rows = [(f"v{i:02d}", [float(f) for f in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>"), x


def test_a_vector_finds_itself(vectors):
    store, _ = vectors
    query = store.where("chunk_id = 'v05'").select(F.lit(1).alias("query_id"), "embedding")
    hits = search.top_k(store, query, 3).orderBy("place").collect()
    assert len(hits) == 3 and hits[0]["id"] == "v05"
    assert search.top_k(store, query, 99).count() == 20
    assert search.top_k(store.limit(0), query, 3).count() == 0
    assert search.top_k(store, query.limit(0), 3).count() == 0


def test_blocks_equal_broadcast_and_numpy(vectors):
    store, x = vectors
    queries = store.select(F.col("chunk_id").alias("query_id"), "embedding")
    wanted = {f"v{i:02d}": [f"v{j:02d}" for j in np.argsort(-(x.astype(float) @ x[i].astype(float)), kind="stable")[:4]]
              for i in range(20)}
    for options in ({}, {"max_broadcast": 3, "rows_per_cell": 6}):
        hits = search.top_k(store.repartition(3), queries, 4, **options).orderBy("query_id", "place").collect()
        got = {}
        for h in hits:
            got.setdefault(h["query_id"], []).append(h["id"])
        assert got == wanted


def test_equal_scores_go_to_the_lower_id(spark):
    store = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "chunk_id long, embedding array<float>")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    hits = search.top_k(store.repartition(7), query, 3).orderBy("place").collect()
    assert [h["id"] for h in hits] == [0, 1, 2]


def docs(spark):
    rows = [("a", "WAC", "Policy", "The wholesale acquisition cost is a list price."),
            ("b", "340B", "Program", "The ceiling price binds covered entities."),
            ("c", "Price", "Medicaid", "Medicaid best price is the lowest price available to any buyer.")]
    return spark.createDataFrame(rows, retrieval.DOCUMENT)


def test_retrieval(spark, tmp_path):
    index, model = retrieval.build(docs(spark), str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "What is Medicaid best price?")], "query_id int, text string")
    hits = retrieval.retrieve(index, model, asked, k=1).collect()
    assert [h["doc_id"] for h in hits] == ["c"] and 0 < hits[0]["similarity"] <= 1.000001
    assert load_index(spark, str(tmp_path / "index")).count() == 3
    with pytest.raises(FileNotFoundError):
        load_index(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        retrieval.build(docs(spark).withColumn("content", F.lit(" ")).unionByName(docs(spark)).where("content = ' '"),
                        str(tmp_path / "empty"))


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 1, "rows_per_cell": 2}])
def test_chunks_of_one_id_stay_apart(spark, tmp_path, options):
    index, model = retrieval.build(docs(spark), str(tmp_path / "index"))
    one_id = index.withColumn("chunk_id", F.lit("0" * 12))
    rows = [(1, "What is Medicaid best price?"), (2, "wholesale acquisition cost")]
    asked = spark.createDataFrame(rows, "query_id int, text string")
    hits = retrieval.retrieve(one_id, model, asked, k=1, **options).orderBy("query_id").collect()
    assert [(h["query_id"], h["doc_id"], h["place"]) for h in hits] == [(1, "c", 1), (2, "a", 1)]
    assert hits[0]["text"].startswith("Medicaid") and hits[0]["id"] == "0" * 12
    assert retrieval.retrieve(one_id, model, asked, k=2, **options).count() == 4


def test_embeddings_have_length_one(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    texts = spark.createDataFrame([("abc",), ("",)], "text string")
    for r in embed.model_embed(texts, load).collect():
        assert np.linalg.norm(r["embedding"]) == pytest.approx(1.0, abs=1e-6)
    rows = embed.tfidf_embed(docs(spark), embed.fit_tfidf(docs(spark), "content")).collect()
    assert all(len(r["embedding"]) == 384 and np.linalg.norm(r["embedding"]) == pytest.approx(1, abs=1e-5) for r in rows)


def test_directories_and_strings(spark, tmp_path):
    assert retrieval.read_directory(spark, str(tmp_path / "nonexistent")).count() == 0
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.txt").write_text("first\nsecond")
    row = retrieval.read_directory(spark, str(tmp_path / "x")).first()
    assert (row["title"], row["content"]) == ("one.txt", "first\nsecond")
    assert retrieval.text_document(spark, "body", "Guide").first()["title"] == "Guide"


def test_context_budget(spark):
    rows = [(1, 1, "a" * 4000, "T", "X"), (1, 2, "b" * 4000, "T", ""), (1, 3, "c", "T", "X"), (2, 1, "d", None, None)]
    ranked = spark.createDataFrame(rows, "query_id int, place int, text string, topic string, title string")
    got = {r["query_id"]: r for r in context.context_pack(ranked).collect()}
    assert (got[1]["passages"], got[1]["body_chars"]) == (2, 6000)
    assert got[1]["context"] == "[T — X]\n" + "a" * 4000 + "\n\n---\n\n[T]\n" + "b" * 2000
    assert got[2]["context"] == "[]\nd"


def murmur3(data: bytes) -> int:
    """MurmurHash3, 32 bits, seed 42, signed."""
    h = 42
    rotated = lambda x, n: (x << n | x >> 32 - n) & 0xFFFFFFFF
    for at in range(0, len(data), 4):
        part = data[at:at + 4]
        h ^= rotated(int.from_bytes(part, "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        if len(part) == 4:
            h = (rotated(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (h >> 31 << 32)


def test_registered_vectors_like_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    chunks = QUERIES["chunk_docs"](spark, folder).select("doc_id", "chunk_index", "text").collect()
    counts = {}
    for doc, place, text in chunks:
        words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()
        counts[doc, place] = np.bincount(np.array([murmur3(w.encode()) % 384 for w in words], int), minlength=384)
    having = sum((c > 0).astype(int) for c in counts.values())
    idf = np.log((len(counts) + 1) / (having + 1))
    got = QUERIES["tfidf_embed"](spark, folder).collect()
    assert len(got) == len(counts)
    for r in got:
        want = counts[r["doc_id"], r["chunk_index"]] * idf
        want = want / (np.linalg.norm(want) or 1.0)
        assert np.abs(np.array(r["embedding"].split(","), float) - want).max() < 1e-5


def test_a_score_is_the_same_in_any_batch():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(700, 48)) * 30, rng.normal(size=(60, 48))
    ids = pd.DataFrame({"id": np.arange(len(x))})
    whole = search.score(ids, x, q, 50)
    for n in range(0, 60, 7):
        alone = search.score(ids, x, q[n:n + 1], 50)
        assert whole[whole["query"] == n][["id", "score"]].values.tolist() == alone[["id", "score"]].values.tolist()
    part = search.score(ids.iloc[:333].reset_index(drop=True), x[:333], q, 333)
    known = {(r.query, r.id): r.score for r in search.score(ids, x, q, 700).itertuples()}
    assert all(known[r.query, r.id] == r.score for r in part.itertuples())
