"""What every training-data operator makes of odd tables, and queries against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from concord.llm import embedding_links, language_id, ngram_lm, packing, piece_bpe, sharding, simhash, sketches, token_files, toxicity
from concord.llm.queries import PIECE_BPE, WORD_BPE, vocabulary

CLASH = ["score", "lang_pred", "held_out", "row", "hash", "label", "h", "n", "part", "copy", "shard", "slot", "fp", "component", "_row", "_bucket", "length", "rank", "id", "a.b", "block", "text_crc32"]
LONG = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(1 << 20))


def _table(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 1, *range(len(CLASH))) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"), (2, "la casa es de la gente", "es"), (2, "the other text of two", "en"), (None, "no id here at all", "en"), (None, None, None), (3, "", "es"), (4, LONG, "en"), (5, "the cat sat on the mat", None), (6, " 12 !! ", "en")]
    return _table(spark, rows), [(d, t or "") for d, t, _ in rows]


OPERATORS = {
    "op2": lambda d, lab: token_files.read_tokens(token_files.write_tokens(d, vocabulary(WORD_BPE))),
    "op3": lambda d, lab: piece_bpe.encode_and_decode(d, vocabulary(PIECE_BPE)),
    "op4": lambda d, lab: sharding.assign_shards(d),
    "op5": lambda d, lab: ngram_lm.score_documents(d, F.col("doc_id") == 2),
    "op6": lambda d, lab: toxicity.classify(d, lab, F.coalesce(F.col("doc_id") == 3, F.lit(False))),
    "op7": lambda d, lab: language_id.identify(d, F.coalesce(F.col("doc_id") == 3, F.lit(False))),
    "op8": lambda d, lab: packing.pack(d, vocabulary(WORD_BPE)).where("piece = 0"),
    "op9": lambda d, lab: sketches.compare_neighbours(d, 3),
    "op10": lambda d, lab: simhash.simhash_components(d),
    "language": lambda d, lab: language_id.drop_unidentified(d, F.lit(True)),
    "toxicity": lambda d, lab: toxicity.drop_toxic(d, lab, F.lit(True)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_long_words_clashing_columns_and_no_rows(spark, odd, name):
    docs, rows = odd
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    out = OPERATORS[name](docs, labels)
    got = [r["doc_id"] for r in out.collect()]
    if name in ("language", "toxicity"):
        assert out.columns == docs.columns and out.schema == docs.schema
        assert name == "toxicity" or collections.Counter(got) == collections.Counter(d for d, t in rows if any(c.isalpha() for c in t))
    else:
        assert collections.Counter(got) == collections.Counter(d for d, _ in rows)
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_near_duplicates_keep_all_columns_of_any_name(spark, odd):
    docs, _ = odd
    out = simhash.drop_near_duplicates(docs)
    assert out.schema == docs.schema and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 2, 2, 3, 4, 6] and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_ties_and_one_class_alone(spark):
    docs = spark.createDataFrame([(k, "same words here") for k in range(6)], "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "bb").otherwise("aa"))
    assert {r["lang_pred"] for r in language_id.identify(docs, F.lit(False)).collect()} == {"aa"}
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    assert {r["predicted"] for r in toxicity.classify(docs, labels, F.lit(False)).collect()} == {0}
    mixed = labels.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    assert len({r["score"] for r in toxicity.classify(docs, mixed, F.lit(False)).collect()}) == 1


def _jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards_against_a_scalar_jump(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(rng.randrange(10**9), rng.choice(["", "ä b", "word", None])) for _ in range(2500)] + [(7, "equal")] * 1500, "doc_id long, text string")
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("k")).distinct().collect()}
    got = sharding.assign_shards(docs, 16).collect()
    for r in got:
        key = keys[r["doc_id"]] % 2**64
        assert (r["shard"], r["grown_shard"]) == (_jump(key, 16), _jump(key, 17)) and r["law"] == "key"
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_packed_pieces_against_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(vocabulary(WORD_BPE)), random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma!", "x1"]) for _ in range(rng.choice([0, 1, 5, 30, 90])))) for k in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(WORD_BPE), 40).collect()
    want = {}
    for d, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 40)):
            want[d, piece] = (at, len(ids[at : at + 40]), zlib.crc32(np.array(ids[at : at + 40], "<u4")))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    sequences = len({r["sequence_id"] for r in got})
    assert sequences <= -(-sum(n for _, n, _ in want.values()) // 40) + 1


def _sketch(text):
    """The kept hashes of a text, one shingle after another."""
    mask = 2**64 - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        value = 0
        for k in range(5):
            value = mix((value * 0x9E3779B97F4A7C15 + (hashes[i + k] if i + k < len(hashes) else k)) & mask)
        out.add(value)
    kept = {v for v in out if v < 2**64 // 8}
    return kept or ({min(out)} if out else set())


def _likeness(a, b):
    union = a | b
    kept = {v for v in union if v < 2**64 // 8} or ({min(union)} if union else set())
    return len(kept & a & b) / len(kept) if union else 1.0


def test_sketches_against_sets(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Ab", "c", "dé", "e", "ff", "g"]) for _ in range(rng.randrange(80))) for _ in range(40)] + ["", "one", "one two"]
    texts.sort(key=lambda t: hashlib.md5(t.encode()).digest())
    got = {r["doc_id"]: r for r in sketches.compare_neighbours(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()}
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        mine, other, changed = _sketch(t), _sketch(after), _sketch(edited)
        assert got[k]["fingerprint"] == "".join(f"{v:016x}" for v in sorted(mine)) and got[k]["edited_fingerprint"] == "".join(f"{v:016x}" for v in sorted(changed))
        assert got[k]["near_edited"] == pytest.approx(_likeness(mine, changed)) and got[k]["near_next"] == pytest.approx(_likeness(mine, other))


def test_containment_columns_follow_from_the_fingerprints(spark):
    texts = ["a b c d e f g h", " ".join(f"w{k}" for k in range(400)), " ".join(f"w{k}" for k in range(3000)), "", None]
    got = {r["doc_id"]: r for r in sketches.compare_neighbours(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).collect()}
    for k, r in got.items():
        own, after, edited = (sketches.from_text(f) for f in (r["fingerprint"], got[(k + 1) % 5]["fingerprint"], r["edited_fingerprint"]))
        assert (r["contained_next"], r["contained_edited"]) == (sketches.containment(own, after), sketches.containment(own, edited))
    # a short text inside a much longer one: all of it is held, though the two are hardly alike
    assert got[1]["contained_next"] == 1.0 and got[1]["near_next"] < 0.3


def test_containment_of_unequal_texts():
    words = [f"w{k}" for k in range(4000)]
    short, long = (sketches.sketches(pa.array([" ".join(w)]))[0] for w in (words[1000:1600], words))
    assert sketches.containment(short, long) == 1.0 and sketches.containment(long, short) < 0.25


@pytest.mark.parametrize(("slab", "tile"), [(4096, 256), (64, 16)])
def test_links_in_many_slabs_and_tiles(spark, slab, tile, monkeypatch):
    monkeypatch.setattr(embedding_links, "SLAB", slab)
    monkeypatch.setattr(embedding_links, "TILE", tile)
    r = np.random.default_rng(7)
    centres = r.normal(size=(25, 64))
    x = [centres[r.integers(25)] + r.normal(size=64) * r.choice([0.15, 0.3, 1.0]) for _ in range(400)]
    x += [x[0] * 1e200, x[1] * 1e-200, x[2] * 2.0]
    rows = [(k, [float(v) for v in row], int(k % 2) if k < 400 else (k - 400) % 2, 1) for k, row in enumerate(x)]
    got = {q["vec_id"]: (q["n_links"], q["component_id"]) for q in embedding_links.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")).collect()}
    scaled = np.array([v / np.abs(v).max() for v in x])
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    label = np.array([row[2] for row in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    name = np.arange(len(x))
    for _ in range(100):
        name = np.minimum(name, np.where(near, name[None, :], len(x)).min(1))
    assert got == {k: (int(near[k].sum()), int(name[k])) for k in range(len(x))} and near.sum() > 400


def test_slabs_meet_only_where_their_boxes_allow_a_link(spark, monkeypatch):
    """Clusters spread over many directions: few of the possible pairs of slabs meet, and no link is lost."""
    monkeypatch.setattr(embedding_links, "SLAB", 32)
    monkeypatch.setattr(embedding_links, "TILE", 8)
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16))
    x = np.repeat(centres, 40, 0) + 0.15 * r.normal(size=(1600, 16))
    df = spark.createDataFrame([(k, "one", v.tolist()) for k, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = ((unit @ unit.T) >= 0.93).sum(1) - 1
    got = {g["vec_id"]: g["n_links"] for g in embedding_links.link_embeddings(df).collect()}
    assert [got[k] for k in range(1600)] == want.tolist() and want.sum() > 10_000
    classes = df.select(F.col("vec_id").alias("id"), "label", F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("vector"))
    slabs = embedding_links._slabs(classes, embedding_links.axes(classes))
    n, met = slabs.count(), embedding_links.slab_pairs(slabs, 0.93).count()
    assert met < 0.6 * n * (n + 1) / 2, (met, n)
