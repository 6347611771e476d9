"""Line dedup, spelling variants and lexical search against brute force, with odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from concord.llm import lexical_search, line_dedup, spelling

WHITE = " \t\n\x0b\x0c\r"
ODD = "doc_id long, text string, key string, line string, h1 int, pos int, runs int, word string, n int, near string, item int, score int, ids int, term string, `a.b` int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def odd(spark, rows):
    return spark.createDataFrame([(d, t, *["x" if k in (0, 1, 5, 7, 11) else 1 for k in range(13)]) for d, t in rows], ODD)


def dropped_by_hand(rows, key_chars, fewest):
    held = collections.defaultdict(set)
    small = -1
    number = lambda d: small if d is None else d
    keys = lambda t: [lower(line.strip(WHITE)) for line in (t or "").split("\n")]
    for d, t in rows:
        for k in keys(t):
            if len(k) >= key_chars:
                held[k].add(number(d))
    out = collections.Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        stays = [len(k) < key_chars or len(held[k]) < fewest or number(d) == max(held[k]) for k in keys(t)]
        out[d, len(lines), stays.count(False), "\n".join(x for x, s in zip(lines, stays, strict=True) if s)] += 1
    return out


def lines_table(rng):
    shared = ["A Licence Line that many share ", "\tÉcole de la RUE, numéro sept", "short one", "", "the commonest line of them all, here", "x" * 20]
    rows = [(k, "\n".join([rng.choice(shared) for _ in range(rng.randrange(6))] + [f"line of its own number {k}"])) for k in range(120)]
    hot = [(1000 + k, "the commonest line of them all, here\n  THE commonest line of them all, here") for k in range(300)]
    return rows + hot + [(5, "x" * 20), (5, rows[5][1]), (None, shared[0]), (None, f"{shared[1]}\n{shared[1]}"), (7, None), (8, ""), (9, "long " * 200_000 + "\n" + shared[0]), (10, "\n\n")]


def test_lines_against_brute_force(spark, monkeypatch):
    rows = lines_table(random.Random(1))
    want = dropped_by_hand(rows, 20, 3)
    for most in (line_dedup.MOST_FREQUENT, 1):  # hashes summed apart; nearly all streamed
        monkeypatch.setattr(line_dedup, "MOST_FREQUENT", most)
        got = line_dedup.deduplicate_lines(odd(spark, rows)).collect()
        assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == want
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    got = line_dedup.line_dedup_digest(odd(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_dropped"], r["kept_sha256"]) for r in got) == collections.Counter({(d, n, hashlib.sha256(t.encode()).hexdigest()): c for (d, _, n, t), c in want.items()})
    assert line_dedup.deduplicate_lines(odd(spark, rows).limit(0)).count() == 0


def test_bitmaps_count_lines_in_turn(spark):
    same = "this is the shared line, long enough"
    docs = spark.createDataFrame([(1, f"a\n{same}\n{same}\nb\n{same}"), (2, same), (3, same)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert got == {1: [(1, 2), (1, 1)], 2: [(0, 1)]}


def words_by_hand(rows, shortest, fewest):
    counts = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def spelling_by_hand(words):
    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = (form, n, len(close), words[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def spelling_table(rng):
    bases = ["color", "colour", "colours", "aaaaa", "aaaaaa", "aaaaaaa", "étudier", "×÷×÷×", "letter", "lettre", "banana", "abcde"]
    edit = lambda w: (lambda at: rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abeÿ") + w[at:], w[:at] + rng.choice("abeÿ") + w[at + 1 :]]))(rng.randrange(len(w)))
    pool = bases + [edit(rng.choice(bases)) for _ in range(300)] + ["q" * n for n in (63, 64, 65, 66)] + ["q" * 30 + "r" + "q" * 34]
    return [(k, " ".join(rng.choice(pool[: rng.choice([12, 60, 400])]) for _ in range(60)).upper() + ", Ābc日本 9word") for k in range(150)]


def test_spelling_against_brute_force(spark):
    long = "".join(random.Random(2).choices("abcdé", k=5000))
    rows = spelling_table(random.Random(3)) + [(None, None), (None, "color " * 5), (4, ""), (6, "colour"), (6, "colour")] + [(k, f"{long} {long[:70]}z{long[70:]} {long[1:]}") for k in range(200, 204)]
    want = spelling_by_hand(words_by_hand(rows, 5, 3))
    assert max(map(len, want)) > 1000 and any(v[1] != w and v[0] != v[1] for w, v in want.items())
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(odd(spark, rows)).collect()}
    assert got == want
    assert spelling.group_variants(odd(spark, rows).limit(0)).count() == 0


def test_both_ways_of_neighbours_agree(spark):
    words = spark.createDataFrame([(w,) for w in words_by_hand(spelling_table(random.Random(4)), 2, 1) if len(w) <= 64], "word string")
    pairs = lambda df: {(r["word"], r["near"]) for r in df.collect()}
    assert pairs(spelling.short_neighbours(words)) == pairs(spelling.long_neighbours(words))


def search_by_hand(docs, items, top):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t or ""))
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    documents, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = collections.Counter()
    for item, text in items:
        found = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * documents // total
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, math.inf if d is None else d))
        for rank, (s, d) in enumerate(sorted(found)[:top], 1):
            out[item, rank, None if d == math.inf else d, -s] += 1
    return out


@pytest.mark.parametrize(("block", "items_a_pass", "wanted"), [(1024, 1024, 500_000), (8, 3, 5)])
def test_search_against_brute_force(spark, monkeypatch, block, items_a_pass, wanted):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "ITEMS", items_a_pass)
    monkeypatch.setattr(lexical_search.document_frequencies, "__defaults__", (wanted,))
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(200)] + ["Élan", "日本", "it's"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(pool[min(int(rng.expovariate(0.03)), 202)] for _ in range(n))
    docs = [(k, text(rng.choice([1, 5, 30, 200]))) for k in range(150)] + [(500, "w1 " * 30_000 + text(9)), (None, "w7 w9"), (3, "w7 W9"), (3, "w7 w9"), (8, None), (9, ""), (11, "-- ..")]
    items = [(k, text(rng.choice([1, 3, 12]))) for k in range(12)] + [(50, None), (51, "..."), (52, "unheard"), (53, "W7 w9 w7"), (7, "w2")]
    got = collections.Counter(tuple(r) for r in lexical_search.search(odd(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))).select("item_id", "rank", "doc_id", "score").collect())
    assert got == search_by_hand(docs, items, 10)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(odd(spark, docs), empty).count() == 0 and lexical_search.search(odd(spark, docs).limit(0), empty.unionByName(spark.createDataFrame(items, empty.schema))).count() == 0
