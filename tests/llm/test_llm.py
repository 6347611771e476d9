"""The training-data operators against brute force, round trips and the libraries, with nulls, ties and odd columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from concord.llm import embedding_links, language_id, ngram_lm, packing, piece_bpe, sharding, simhash, sketches, token_files, toxicity
from concord.llm.elias_fano import EliasFano, encode
from concord.llm.queries import PIECE_BPE, WORD_BPE, vocabulary
from concord.llm.word_bpe import word_bpe

TEXTS = ["The cat sat on the mat.", "The cat sat on the mat.", "", None, "é’s «x» 12,5% don't", "  \n\t ", "a " * 3000, "日本語 text\x00 mixed ▁ marks", "word", "Word", "one two three four five six seven eight nine ten"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 0, "clash", 1) for k, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, None, None), (3, "same id", "en", "s", 0, "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, fp int")


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_elias_fano_selects_and_decodes():
    r = np.random.default_rng(1)
    for n, top in ((0, 0), (1, 9), (1000, 10**6), (700, 50), (600, 2**62)):
        values = np.sort(r.integers(0, top + 1, n).astype(np.uint64))
        view = EliasFano(encode(values, top))
        assert (view.decode() == values).all()
        if n:
            at = r.integers(0, n, 40)
            assert (view.select(at) == values[at]).all()
        values = np.unique(values)
        view, asked = EliasFano(encode(values, top)), np.concatenate([values, r.integers(0, top + 1, 50).astype(np.uint64)])
        place = {int(x): i for i, x in enumerate(values)}
        want = np.array([place.get(int(x), -1) for x in asked])
        begin = r.integers(0, len(values) + 1, len(asked))
        end = np.minimum(len(values), begin + 40)
        assert (view.find(asked) == want).all() and (view.find(asked, begin, end) == np.where((want >= begin) & (want < end), want, -1)).all()


def test_word_bpe_equals_the_library():
    coder = word_bpe(vocabulary(WORD_BPE))
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "é", ".", ",", " ", "\n", "'", "!", "$", "1", "İ", "K", "<|endoftext|>", "日", "s", "̸", "="]) for _ in range(rng.randrange(50))) for _ in range(1500)]
    ids, counts = coder.encode(pa.array(texts), 1)
    want = [e.ids + [1] for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_word_bpe_takes_added_tokens_like_a_fresh_tokenizer(spark):
    from tokenizers import Tokenizer

    path = vocabulary(WORD_BPE)
    fresh, rng = Tokenizer.from_file(path), random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "<", "\u0338", "!", "a", "é", " ", "\n", "'s", "1", "x.", "\xa0"]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b.", "<|endoftext|>\u0338!?"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)]
    want = [e.ids + [1] for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [3306, 49407, 1002, 1]
    ids, counts = word_bpe(path).encode(pa.array(texts), 1)
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
    docs = spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string")
    rows = token_files.read_tokens(token_files.write_tokens(docs, path), with_ids=True).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in rows] == want[:50] and [r["start"] for r in rows] == [sum(map(len, want[:k])) for k in range(50)]
    assert sum(r["length"] for r in packing.pack(docs, path).collect()) == sum(map(len, want[:50]))


def test_token_files_round_trip(spark, docs):
    path = vocabulary(WORD_BPE)
    got = token_files.read_tokens(token_files.write_tokens(docs, path), with_ids=True).collect()
    tokenizer = word_bpe(path).tokenizer
    start = 0
    for (d, t), r in zip(sorted(rows_of(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), sorted(got, key=lambda r: r["start"]), strict=True):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (d, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4"))
        start += len(ids)
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), path)).count() == 0


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = vocabulary(PIECE_BPE)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in piece_bpe.encode_and_decode(docs, path).join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> 3").collect():
        ids = model.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4")).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    coder, rng = piece_bpe.piece_bpe(path), random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "aa", " ", "  ", "\n", "▁", "é", "日", "\U0001f600", "\x00", "ing", "....", "<s>", "<0x41>"]) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["a" * 999, "-" * 333]
    ids, counts = coder.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in model.encode(t, add_bos=True, add_eos=True)]
    loose = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), 1, 2]) for _ in range(rng.randrange(12))] for _ in range(800)]
    got = coder.decode(np.array([i for x in loose for i in x]), np.array([len(x) for x in loose]))
    assert [g.decode() for g in got] == [model.decode(x) for x in loose]


def test_jump_shards_move_only_into_the_new_one(spark, docs):
    keys = np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2, 7, 16):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and a.max() < n
    got = sharding.assign_shards(docs, 4).collect()
    assert len(got) == docs.count() and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(4))
    assert {r["size"] for r in got if r["doc_id"] == 2} == {1}
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    back = spark.read.parquet(sharding.write_shards(docs.select("doc_id", "text"), 4))
    assert back.count() == docs.count()


@pytest.mark.parametrize(("block", "shard"), [(2_000_000, 600_000), (60, 40)])
def test_language_model_against_counting(spark, docs, block, shard, monkeypatch):
    """One block and shard, and several of both with hot words."""
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(ngram_lm, "SHARD_ENTRIES", shard)
    rng = random.Random(21)
    more = spark.createDataFrame([(100 + k, " ".join(rng.choice(["of", "The", "a", *(f"w{j}" for j in range(30))]) for _ in range(rng.randrange(30)))) for k in range(60)], "doc_id long, text string")
    table = docs.where("doc_id is null or doc_id <> 3").select("doc_id", "text").unionByName(more).repartition(3)
    held = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) == 1
    got = ngram_lm.score_documents(table, held).collect()
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + ["<end>"]
    texts = {d: words(t) for d, t in rows_of(table)}
    train = [w for d, w in texts.items() if (d or 0) % 3 != 1]
    c = collections.Counter(x for w in train for x in w)
    pairs = collections.Counter(p for w in train for p in zip(["<end>", *w], w, strict=False))
    after = collections.Counter(a for a, _ in pairs)
    n, v = c.total(), len(c)
    near = lambda p: 2.0 ** (-round(-math.log2(p) * 2048) / 2048) if p > 0 else 0.0
    assert len(got) == len(texts)
    for r in got:
        w = texts[r["doc_id"]]
        score = 0.0
        for a, b in zip(["<end>", *w], w, strict=False):
            p = (c[b] + 1) / (n + v + 1)
            if c[a]:
                p = near(max(pairs[a, b] - 0.75, 0) / c[a]) + near(0.75 * after[a] / c[a]) * p
            score += math.log10(p)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r["score"] == pytest.approx(score)
    assert ngram_lm.score_documents(docs.limit(0), held).count() == 0


def test_trie_searches_successors_of_a_context_alone():
    r = np.random.default_rng(5)
    contexts = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    after = [np.unique(r.integers(0, 2**32, int(n)).astype(np.uint64)) for n in r.pareto(0.8, len(contexts)) * 3 % 4000 + 1]
    sizes = np.array(list(map(len, after)))
    counts = r.integers(1, 9, sizes.sum())
    totals = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
    trie = ngram_lm.Trie(ngram_lm.build_trie(contexts, sizes, np.concatenate(after), counts, totals))
    starts = np.cumsum(sizes) - sizes
    for i in range(0, len(contexts), 7):
        other = after[(i + 1) % len(after)]
        asked = np.concatenate([after[i], other])
        want = np.where(np.arange(len(asked)) < sizes[i], 1, np.isin(asked, after[i])) > 0
        got = trie.find(contexts[i : i + 1], np.array([len(asked)]), asked)
        assert ((got > 0) == want).all()
        p = (counts[starts[i] : starts[i] + sizes[i]] - 0.75) / totals[i]
        assert np.allclose(ngram_lm.dequantise(got[: sizes[i]]), p, rtol=2e-4)
    assert (trie.find(np.array([5], np.uint64), np.array([2]), np.array([1, 2], np.uint64)) == 0).all()
    assert np.allclose(ngram_lm.dequantise(trie.weigh(contexts)), 0.75 * sizes / totals, rtol=2e-4) and trie.weigh(np.array([5], np.uint64))[0] == 0


def test_toxicity_compressed_lengths_and_thresholds():
    """Gains are the difference of the compressed lengths of the whole frames; evidence is the sum of what exceeds the thresholds."""
    import zstandard

    rng = random.Random(11)
    plain = ["".join(rng.choice(["ba", "ko", "ri", "mu", "so"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    toxic = [" ".join([*rng.sample(plain, 30), "idiot", "Scumbag!"]) for _ in range(40)]
    ordinary = [" ".join(rng.sample(plain, 30)) for _ in range(60)]
    model = toxicity.fit(toxic, ordinary)
    text = ordinary[0] + " scumbag " + "x" * 200
    sizes = []
    for d in (model.ordinary, model.toxic):
        kind = zstandard.ZstdCompressionDict(d + toxicity.PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(9, strategy=zstandard.STRATEGY_BTOPT, window_log=20, hash_log=17, chain_log=17, search_log=8, min_match=6, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append({w: len(zstandard.ZstdCompressor(dict_data=kind, compression_params=p).compress(toxicity.PRIMER + toxicity.spell(w))) for w in toxicity.text_windows(text)})
        assert all(zstandard.ZstdDecompressor(dict_data=kind).decompress(zstandard.ZstdCompressor(dict_data=kind, compression_params=p).compress(toxicity.spell(w)), max_output_size=999) == toxicity.spell(w) for w in list(sizes[-1])[:5])
    limit = lambda n: model.quiet[min(model.quiet, key=lambda x: (abs(x - n), x))]
    want = sum(max(0, sizes[0][w] - sizes[1][w] - limit(min(24, len(w)))) for w in toxicity.text_windows(text)) / (len(toxicity.text_windows(text)) + 20) ** 0.5
    assert model.evidence(pa.array([text]))[0] == pytest.approx(want) and (model.scores(model.evidence(pa.array([text, ordinary[1], "", None]))) >= 0.5).tolist() == [True, False, False, False]
    # thresholds of lengths that the sample lacks do not depend on what was asked before
    asked = [model.excess(b" " + b"q" * n + b" ") for n in (14, 15, 40)]
    assert [toxicity.fit(toxic, ordinary).excess(b" " + b"q" * n + b" ") for n in (40, 15, 14)] == asked[::-1]


def test_toxicity_of_stems_and_words_among_syllables(spark):
    """Prose of syllables in four languages, with junk; toxic texts hold insults or, in two languages, stems with any ending, which
    ordinary texts hold now and then."""
    rng = random.Random(21)
    kinds = [["th", "er", "an", "in", "re", "he", "nd", "ti", "es", "ou"], ["sch", "lich", "keit", "ver", "ung", "ein", "ach", "ge"], ["eau", "que", "ment", "ré", "oi", "eux", "tion"], ["ción", "ado", "os", "arr", "mente", "ez", "bo"]]
    kinds = [[*kind, *{rng.choice(letters) + rng.choice("aeiouy") + rng.choice(["", *letters]) for _ in range(40)}] for kind, letters in zip(kinds, ["thsndrl", "schnbtg", "rlmnpv", "cdñrlj"], strict=True)]
    kinds = [sorted(kind) for kind in kinds]
    insults = [["idiot", "moron", "trash", "scum", "clown"], ["achlich"], ["réeux"], ["Loser", "pathetic"]]
    rows, labels = [], []
    for k in range(2400):
        lang = rng.choice([0, 0, 1, 2, 3])
        words = ["".join(rng.choice(kinds[lang]) for _ in range(rng.choice([1, 2, 2, 3, 3]))) for _ in range(rng.choice([60, 150, 600]))]
        bad = k % 8 == 0
        for _ in range(rng.choice([3, 4, 6]) * (1 + len(words) // 200) if bad else 0):
            insult = rng.choice(insults[lang])
            words.insert(rng.randrange(len(words)), insult if lang in (0, 3) else insult + rng.choice(kinds[lang]))
        if k % 11 == 0:
            words += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400)), "###", "12.50"]
        rows.append((k, " ".join(words) + "."))
        labels.append((k, int(bad)))
    got = [r for r in toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 == 0).collect() if r["held_out"]]
    bad = [r for r in got if r["doc_id"] % 8 == 0]
    found, wrong = sum(r["predicted"] for r in bad), sum(r["predicted"] for r in got if r["doc_id"] % 8)
    assert found >= 0.8 * len(bad) and wrong <= 0.02 * len(got), (found, len(bad), wrong, len(got))


def _made(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    plain = [rng.choice("bcdfgmnprt") + rng.choice("aeiou") + rng.choice("lnrst") + rng.choice(["", "ing", "ed", "ation"]) for _ in range(400)]
    rows, labels = [], []
    for k in range(600):
        text, bad = _made(rng, plain, 60).split(), k % 3 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["idiot", "scumbag", "worthless"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    rows += [(1000, None), (1001, "")]
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 == 0).collect()
    wrong = [r for r in got if r["held_out"] and r["doc_id"] < 600 and r["predicted"] != int(r["doc_id"] % 3 == 0)]
    assert len(wrong) <= 3 and all(0 <= r["score"] <= 1 for r in got) and all(r["predicted"] == 0 for r in got if r["doc_id"] >= 1000)


def test_automaton_counts_greedy_phrases():
    rng = random.Random(2)
    source = "".join(rng.choice("abc ") for _ in range(300))
    automaton = language_id.Automaton(source)
    for _ in range(60):
        word = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 20)))
        points = np.array([ord(c) for c in word])
        assert automaton.phrases(points, np.array([0]), np.array([len(word)]))[0] == _greedy(word, source), word


def _greedy(text, source):
    """Phrases of a text against a source, by substring search."""
    n, at = 0, 0
    while at < len(text):
        size = next((s for s in range(len(text) - at, 0, -1) if text[at : at + s] in source), 1)
        n, at = n + 1, at + size
    return n


def test_language_prediction_equals_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "SEGMENT", 16)
    rng = random.Random(12)
    kinds = {"xx": "abcd", "yy": "bcde", "zz": "cdef"}
    made = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))
    samples = {name: [made(letters, 40), made(letters, 30).upper()] for name, letters in kinds.items()}
    model = language_id.LanguageModel(samples)
    texts = [made(rng.choice(list(kinds.values())), rng.randrange(1, 12)) + rng.choice(["", " 12", "!", " q"]) for _ in range(80)] + ["", None, "1 2", "é", "abcd" * 50]
    names, scores = model.predict(pa.array(texts, pa.string()))
    clean = lambda t: " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
    sources = {n: " " + "".join(clean(t).lstrip() for t in ts) for n, ts in samples.items()}
    for t, name, score in zip(texts, names, scores, strict=True):
        if not re.search(r"[^\W\d_]", t or ""):
            assert (name, score) == ("und", 0.0)
            continue
        c = clean(t)
        cost = {n: sum(_greedy(c[a : a + 16], s) for a in range(0, len(c), 16)) * math.log2(len(s)) for n, s in sources.items()}
        assert cost[name] == min(cost.values()) and name == min(n for n in cost if cost[n] == cost[name]), t
        assert score == pytest.approx(1 / sum(2.0 ** (cost[name] - c) for c in cost.values()))


def test_language_held_out(spark):
    rng = random.Random(3)
    kinds = {"xx": ["ba", "ko", "ri", "mu"], "yy": ["str", "ing", "ed", "th"]}
    rows = [(k, _made(rng, ["".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(30)], 20), lang) for k, lang in enumerate(["xx", "yy"] * 100)]
    rows += [(900, None, "xx"), (901, "123 !!", "yy"), (902, "", None)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 3 == 1).collect()
    assert all(r["lang_pred"] == ("xx", "yy")[r["doc_id"] % 2] for r in got if r["doc_id"] < 900)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 900} == {("und", 0.0)}


def test_packing_plan_is_exact_and_full(docs):
    rng = random.Random(6)
    counts = collections.Counter(min(64, int(rng.expovariate(0.06)) + 1) for _ in range(5000))
    used = collections.Counter()
    for lengths, n in packing.plan_packing(counts, 64):
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += n
    assert used == counts
    total = sum(n for _, n in packing.plan_packing(counts, 64))
    assert total <= math.ceil(sum(x * n for x, n in counts.items()) / 64) + 1
    got = packing.pack(docs, vocabulary(WORD_BPE), 50).collect()
    tokenizer = word_bpe(vocabulary(WORD_BPE)).tokenizer
    want = collections.Counter((d, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in rows_of(docs))
    for (d, n), _ in want.items():
        if d != 3:
            assert sum(r["length"] for r in got if r["doc_id"] == d) == n
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 50
    assert packing.pack(docs.limit(0), vocabulary(WORD_BPE)).count() == 0


def test_sketches_and_neighbours(spark, docs):
    a, b = sketches.sketches(pa.array(["a b c d e f g h", ""]))
    assert len(b) == 0 and sketches.resemblance(b, b) == 1.0 and (sketches.from_text(sketches.to_text(a)) == a).all()
    left, right = " ".join(f"w{k}" for k in range(400)), " ".join(f"w{k}" for k in range(200, 900))
    x, y, both = sketches.sketches(pa.array([left, right, left + " " + right]))
    assert sketches.containment(sketches.merge(x, y), both) == 1.0 and 0.05 < sketches.resemblance(x, y) < 0.45
    plain = sorted(((d, t) for d, t in rows_of(docs)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for ranges in (1, 3, 8):
        got = sorted(sketches.compare_neighbours(docs, ranges).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]))
        want = []
        for k, (d, t) in enumerate(plain):
            q = len(t) // 4
            want.append((d, len(t), hashlib.sha256((t[: len(t) - q] + plain[(k + 1) % len(plain)][1][:q]).encode()).hexdigest()))
        assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (0, 1)}) == 1 and sketches.compare_neighbours(docs.limit(0)).count() == 0


def _simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("direct", [256, 1])
def test_simhash_components_equal_brute_force(spark, docs, direct, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(8)
    base = [f"w{rng.randrange(60)}" for _ in range(200)]
    near = [(100 + k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(0, 40)]
    rows = [(d, t) for d, t in rows_of(docs) if d is not None] + near
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [(d, _simhash(t)) for d, t in rows]
    name = {p: min(d for d, q in prints if q == p) for _, p in prints}
    while True:
        new = {p: min(name[q] for q in name if (p ^ q).bit_count() <= 2) for p in name}
        if new == name:
            break
        name = new
    assert got == {(d, f"{p:016x}"): name[p] for d, p in prints}


def test_covering_masks_cover_every_pair():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7 and all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_near_duplicates_leave_one_row(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "a b c d"), (9, "q r s t u v"), (None, "")]
    got = sorted((r["doc_id"] or -1) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [-1, 2, 9]


def test_near_duplicates_go_by_component_not_by_id(spark):
    rows = [(None, "a b c d", 1), (None, "q r s t u v", 2), (None, "q r s t u v", 2), (None, "k l m n o", 3), (7, "e f g h", 4), (7, "x1 x2 x3 x4 x5", 5), (8, "k l m n o", 6), (6, "e f g h", 7), (None, None, 8), (None, "", 9)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    got = [tuple(r) for r in out.collect()]
    empty = [r for r in got if not r[1]]
    assert out.columns == ["doc_id", "text", "n"] and len(empty) == 1 and empty[0] in rows
    assert sorted(r[2] for r in got if r[1]) == [1, 2, 5, 6, 7]


def test_embedding_links_equal_brute_force(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 10))
    x = [*(centres[r.integers(12)] + r.normal(size=10) * 0.15 for _ in range(150)), *([centres[0]] * 5)]
    rows = [(k, [float(v) for v in row], int(k % 2)) for k, row in enumerate(x)]
    rows += [(500, None, 0), (501, [0.0] * 10, 0), (502, [float("nan")] * 10, 0), (503, rows[0][1], None), (504, [1.0, None], 1), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1)]
    got = {q["vec_id"]: (q["n_links"], q["component_id"], q["kept"]) for q in embedding_links.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = {k: np.array(v) for k, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {k: lab for k, _, lab in rows}
    near = {a: [b for b in good if b != a and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.93] for a in good}
    name = {k: k for k, _, _ in rows}
    for _ in range(200):
        name |= {a: min([name[a], *(name[b] for b in near[a])]) for a in good}
    assert got == {k: (len(near.get(k, [])), name[k], name[k] == k) for k, _, _ in rows}
    assert embedding_links.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
