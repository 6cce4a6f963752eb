"""The training-data operators against brute force, the libraries they stand for, and hand-made edge cases."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraloom.llm import bpe, char_model, chat, decontam, langid, near_dedup, perplexity, pii, substring_dedup, toxicity, warc

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " \n\t ", "a", "word " * 4000, "é ß 日本語 🎉", "same text here", "same text here", "x" * 20000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeated rows, extra columns with clashing names."""
    rows = [(k, t, None if k % 2 else "en") for k, t in enumerate(ODD)] + [(None, "no id", None), (3, "a", "en"), (3, "a", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("n_tokens", "ids", "base", "score", "key", "n", "kept", "batch", "spans", "component", "source")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- 1 ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, mid = "é<p>" * 40000, "m" * 1500
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", None), (4, "u", "s"), (5, "u", "s"), (None, "u", mid), (6, "u", mid), (6, "u", mid), (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("size", F.lit(0))
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, t in rows:
        same = [j for j, _, u in rows if u == t and j is not None]
        again = len((t or "").encode()) >= 1000 and i != max(same)
        want.append((i, len((t or "").encode()), sha(t), "revisit" if again else "response", max(same) if again else None))
    assert got == sorted(want, key=str)
    path = str(tmp_path / "w")
    warc.write_archives(pages.limit(0), path)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_reassembles_and_flags(spark, tmp_path):
    def record(kind, rid, block, **more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()], "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=1\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    whole = record("response", "<b>", block)
    parts = [record("response", "<a>", block[:30], WARC_Segment_Number=1), record("continuation", "<a2>", block[30:60], WARC_Segment_Number=2, WARC_Segment_Origin_ID="<a>"), record("continuation", "<a3>", block[60:], WARC_Segment_Number=3, WARC_Segment_Origin_ID="<a>", WARC_Segment_Total_Length=len(block))]
    lost = [record("response", "<c>", block[:30], WARC_Segment_Number=1), record("continuation", "<c3>", block[60:], WARC_Segment_Number=3, WARC_Segment_Origin_ID="<c>", WARC_Segment_Total_Length=len(block))]
    gz = lambda x: (lambda c: c.compress(x) + c.flush())(zlib.compressobj(wbits=31))
    (tmp_path / "1.warc.gz").write_bytes(b"".join(gz(x) for x in [parts[2], whole, parts[0]]))
    (tmp_path / "2.warc").write_bytes(lost[1] + parts[1] + lost[0])
    got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert bytes(got["<a>"].payload) == bytes(got["<b>"].payload) == b"hello world"
    assert got["<a>"].complete and not got["<c>"].complete and got["<c>"].payload is None


# -- 2 ---------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        want = sorted([(r.doc_id, e.ids, library.decode(e.ids, skip_special_tokens=False)) for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False))], key=str)
        assert sorted([(r.doc_id, r.ids, r.decoded) for r in bpe.encode(df, BPE).collect()], key=str) == want
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert sorted(map(tuple, bpe.digests(df, BPE).collect()), key=str) == sorted([(i, len(ids), sha(",".join(map(str, ids))), sha(text)) for i, ids, text in want], key=str)
    assert bpe.encode(none, BPE).count() == 0


def test_bpe_refuses_what_it_would_encode_otherwise(tmp_path):
    spec = json.load(open(BPE, encoding="utf-8"))
    small = spec | {"model": spec["model"] | {"vocab": {k: v for k, v in spec["model"]["vocab"].items() if v < 256}, "merges": []}, "added_tokens": []}
    odd = {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}, {"model": small["model"] | {"dropout": 0.1}}, {"model": small["model"] | {"ignore_merges": True}}
    for k, change in enumerate(({}, *odd)):
        (tmp_path / "t.json").write_text(json.dumps(small | change))
        if k:
            with pytest.raises(ValueError):
                bpe.ByteBPE(str(tmp_path / "t.json"))
        else:
            assert bpe.ByteBPE(str(tmp_path / "t.json")).decode(bpe.ByteBPE(str(tmp_path / "t.json")).encode("aé")) == "aé"


def test_bpe_random_texts():
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(BPE), bpe.ByteBPE(BPE), random.Random(1)
    texts = ["".join(r.choice("abcdeth nrs\n'0127.,éß՘ᲊ漢<|endoftext|>") for _ in range(r.randint(0, 80))) for _ in range(3000)] + ["<|endoftext|>a<|endoftext|>", "ab" * 3000, "z" * 700]
    for t in texts:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids, t


# -- 3 ---------------------------------------------------------------------------------------------------------------


def brute_substring(rows, n=13):
    first, out = {}, []
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, 1 << 62), (1 << 62) - 1 if i is None else i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < ((1 << 62) - 1 if i is None else i):
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(a for a, b in zip(w, gone) if not b)))
    return sorted(out, key=str)


def brute_parse(rows, n=13):
    """For each row, factors as the greedy parse of leftmost sources makes them, by dictionaries."""
    last, source, out = (1 << 63) - 1, {}, []
    rows = [(last if i is None else i, words(t), i) for i, t in rows]
    for i, w, _ in sorted(rows, key=lambda x: (x[0], x[1])):
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            source[key] = min(source.get(key, (i, k)), (i, k))
    for i, w, own in rows:
        found, before = [], None
        for k in range(len(w) - n + 1):
            s = source[tuple(w[k : k + n])]
            if s[0] >= i:
                before = None
                continue
            if before == (s[0], s[1] - 1):
                found[-1][1] = k + n
            else:
                found.append([k, k + n, *s])
            before = s
        out.append((own, len(w), [tuple(f) for f in found]))
    return sorted(out, key=str)


def test_substring_equals_brute_force(spark, docs, odd, none):
    passage = " ".join(f"p{k}" for k in range(30))
    planted = spark.createDataFrame([(5, f"a {passage} b"), (2, passage), (9, f"{passage} {passage[:60]}"), (2, "c " + passage), (None, passage), (7, " ".join(f"p{k}" for k in range(12)))], "doc_id long, text string")
    for df in (docs, odd, planted, docs.unionByName(docs).repartition(7)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = brute_substring(rows)
        got = substring_dedup.spans(df, batch_bytes=20_000, block_windows=500).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
        assert sorted([(r.doc_id, r.n_words, [tuple(f) for f in r.factors]) for r in got], key=str) == brute_parse(rows)
        digests = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(df).collect()], key=str)
        assert digests == sorted([(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in want], key=str)
    assert substring_dedup.digests(none).count() == 0


def test_factors_end_where_the_source_does():
    doc, at = np.array([3, 3, 3, 4, -1, 3, 3, 3]), np.array([5, 6, 7, 0, -1, 8, 9, 2])
    parse = substring_dedup.factors(doc, at, 13)
    assert parse == [(0, 15, 3, 5), (3, 16, 4, 0), (5, 19, 3, 8), (7, 20, 3, 2)]
    assert substring_dedup.merged(parse) == [(0, 20)] and substring_dedup.factors(doc[:0], at[:0], 13) == []


def test_substring_packing():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, np.uint64))
    assert (substring_dedup.unpacked(pa.scalar(substring_dedup.packed(values))) == values).all()


# -- 4 ---------------------------------------------------------------------------------------------------------------


def brute_base(t):
    w, seen, dup = words(t), set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    c, covered = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
    for k in range(len(w) - 4):
        if c[tuple(w[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_base_rules(docs, odd, none):
    for df in (docs, odd):
        texts = defaultdict(set)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].add(brute_base(r.text))
        for r in perplexity.judge(df).collect():
            own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert own in texts[r.doc_id]
            assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
            assert not (r.kept and r.base_failed)
    assert perplexity.judge(none).count() == 0


def brute_kneser_ney(rows):
    """Log-perplexities of characters at orders 5 and 3, by dictionaries."""
    counts = defaultdict(Counter)
    grams = lambda t: [x[k : k + 5] for x in ["\0" * 4 + t] for k in range(len(t))]
    for _, t, lang in rows:
        counts[lang].update(set(grams(t or "")))
    probability = {}
    for lang, n in counts.items():
        levels = [n]
        for _ in range(4):
            levels.append(Counter(g[1:] for g in levels[-1]))
        letters, below = len(levels[-1]), None
        for level in reversed(levels):
            discount = char_model.discounts([sum(c == k for c in level.values()) for k in (1, 2, 3, 4)])
            total, less = Counter(), Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                less[g[:-1]] += discount[min(c, 3)]
            below = {g: (c - discount[min(c, 3)]) / total[g[:-1]] + less[g[:-1]] / total[g[:-1]] * (1 / letters if below is None else below[g[1:]]) for g, c in level.items()}
            probability[lang, len(next(iter(level)))] = below
    mean = lambda t, lang, n: -sum(np.log(probability[lang, n][g[5 - n :]]) for g in grams(t)) / len(t)
    return sorted((k, lang or "", round(mean(t, lang, 5), 2), round(mean(t, lang, 3), 2)) for k, t, lang in rows if t)


def test_model_equals_a_brute_force_kneser_ney(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeé日🎉") for _ in range(r.randint(1, 6)))
    rows = [(k, " ".join(word() for _ in range(r.randrange(60))) if k % 9 else None, r.choice(["en", "fr", None, "", "-"])) for k in range(150)]
    rows += [(150, "a bb a bb c", "en")] * 2 + [(152, "one", "de"), (153, "x" * 5000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    for group in (1000, 2):
        got = char_model.score(df, lambda t: (len(t or ""),), "n_chars long", batch_bytes=4096, group=group, blocks=5).collect()
        assert len(got) == len(rows) and all((x.fifth is None) == (not x.n_chars) for x in got)
        near = lambda x, y: x[:2] == y[:2] and abs(x[2] - y[2]) < 0.011 and abs(x[3] - y[3]) < 0.011
        own = sorted((x.doc_id, x.lang[1:], round(x.fifth, 2), round(x.third, 2)) for x in got if x.n_chars)
        assert len(own) == len(brute_kneser_ney(rows)) and all(map(near, own, brute_kneser_ney(rows)))


def test_levels_are_distributions():
    r = random.Random(3)
    texts = ["".join(r.choice("abc ") for _ in range(r.randrange(1, 80))) for _ in range(30)]
    grams = char_model.Grams.of(texts, char_model.seed_of("+en"))
    levels = char_model.Levels(grams, char_model.seed_of("+en"))
    pairs = char_model.pair_probabilities(*levels.pairs.T, levels.pair_n)
    p5, p3 = levels.probabilities([char_model.counts_of_counts(n) for n in levels.n], pairs)
    seen = Counter()
    for g, p in zip(grams.codes.tolist(), p5):
        seen[tuple(g[:4])] += p
    assert max(seen.values()) <= 1 + 1e-9 and p5.min() > 0 and p3.max() <= 1
    assert all(n == 1 for n in Counter(map(tuple, grams.codes.tolist())).values())
    assert grams.n.tolist() == [sum("".join(chr(c - 1) if c else "\0" for c in g) in "\0" * 4 + t for t in texts) for g in grams.codes.tolist()]


def test_what_is_gathered_grows(docs):
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text]
    sizes = [len(char_model.Grams.of(texts[:n], char_model.seed_of("+en")).n) for n in (25, 50, 100, len(texts))]
    assert sizes == sorted(set(sizes)) and sizes[-1] > 1.5 * sizes[0]


def test_clean_is_kept_and_junk_goes(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = perplexity.judge(d).join(labels, "doc_id").where("NOT base_failed AND quality IS NOT NULL").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.97 and kept[0] < 0.35


def test_ties_and_clashing_columns_are_judged_alike(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    more = d.withColumns({c: F.lit("x") for c in ("fifth", "third", "batch", "block", "median_fifth", "n_chars", "kept", "perplexity")})
    verdict = lambda df: sorted((r.doc_id, r.kept, round(r.perplexity or 0, 2)) for r in perplexity.judge(df).collect())
    assert verdict(more) == verdict(d)
    twice = perplexity.judge(d.unionByName(d)).groupBy("doc_id").agg(F.countDistinct("kept").alias("k"), F.count("*").alias("n")).collect()
    assert all(x.k == 1 and x.n % 2 == 0 for x in twice)


def test_scrambled_words_are_rejected(spark):
    r = random.Random(10)
    common = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(100)]
    text = lambda pick: " ".join(pick() for _ in range(120))
    rows = [(k, text(lambda: r.choice(common)), "en") for k in range(300)]
    rows += [(300 + k, text(lambda: "".join(r.sample(r.choice(common), 5))), "en") for k in range(5)]
    kept = {x.doc_id for x in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert not kept & set(range(300, 305)) and len(kept) >= 295


# -- 5 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows, size):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = words((t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            shared = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or (sets[a] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared) and sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted([(i, len(sets[k]), least.get(find(k)), i is None or i == least[find(k)]) for k, (i, _) in enumerate(rows)], key=str)


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark, odd, none):
    r = random.Random(3)
    texts = [t for _ in range(12) for t in near_copies(r, [f"w{r.randrange(5000)}" for _ in range(r.randint(30, 120))], r.randint(1, 6), 8)]
    texts += [texts[0].upper(), texts[0], "one two", "ONE  two", ""]
    fixture = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (fixture, odd):
        rows = [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]
        got = near_dedup.cluster(df, size=4).collect()
        assert sorted([(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got], key=str) == brute_components(rows, 4)
    assert near_dedup.cluster(none, size=4).count() == 0
    assert near_dedup.remove(fixture).columns == ["doc_id", "text"]


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Large buckets, in several blocks, where many members are not linked to the smallest."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 40)
    r = random.Random(5)
    texts = near_copies(r, [f"w{k}" for k in range(150)], 260, 16)
    rows = list(enumerate(texts))
    got = near_dedup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert sorted([(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got], key=str) == brute_components(rows, 4)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "x"), (None, "x"), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component": F.lit(1), "count": F.lit(2)})
    got = near_dedup.remove(df)
    assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "x"), (None, "x"), (3, "")], key=str)


def test_stars(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(7, 7)], "a long, b long")
    assert {r.node: r.component for r in near_dedup.components(links).collect()} == {k: k // 20 * 20 for k in range(60)}


# -- 6 ---------------------------------------------------------------------------------------------------------------


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", -1.0), ("t", 3, 1, "assistant", "<s>[\\b]</s>", 2.0), ("t", 4, 3, "user", None, 0.5), ("t", 5, 2, "user", "x", 2.0), ("u", 1, 99, None, "r", None), ("c", 1, 2, "user", "a", 1.0), ("c", 2, 1, "user", "b", 1.0), (None, 1, None, "user", "n", 1.0), ("t", 1, None, "user", "q", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumn("up", F.lit(1)).withColumn("total", F.lit(1))
    got = chat.parse(chat.format_paths(chat.paths(df))).collect()
    turns = {r.tree: [(t.role, t.text) for t in r.turns] for r in got}
    assert turns == {"t": [("user", "q"), ("assistant", "<s>[\\b]</s>"), ("user", "")], "u": [("", "r")], None: [("user", "n")]}
    assert {r.tree: r.loss_text for r in got}["t"] == "<s>[\\b]</s>"
    both = chat.paths(df, branches=2).where("tree = 't'").select("leaf").distinct().collect()
    assert sorted(r.leaf for r in both) == [4, 5]
    assert chat.paths(df.limit(0)).count() == 0


def test_deep_trees(spark):
    df = spark.range(300).selectExpr("0 tree", "id node", "id - 1 parent", "'user' role", "cast(id as string) text", "1D score")
    got = chat.paths(df).orderBy("position").collect()
    assert [r.text for r in got] == [str(k) for k in range(300)]


# -- 7 ---------------------------------------------------------------------------------------------------------------


def test_counterfactuals_hold_scores_together():
    """Insults make texts toxic; the data also tie one group's name to the label, which the penalty must undo."""
    r, columns = random.Random(2), toxicity.Columns()
    rows, labels, twins = [], [], []
    for k in range(1200):
        bad = k % 2
        named = r.random() < (0.7 if bad else 0.1)
        w = {r.choice(["table", "river", "stone", "cloud", "green"]), f"filler{r.randrange(40)}"} | ({"scum"} if bad and r.random() < 0.8 else set()) | ({"muslim"} if named else set())
        rows.append(columns.of(w))
        labels.append(bad)
        s = toxicity.swapped(w)
        twins.append(None if s is None else columns.of(s))
    gap = {}
    for strength in (0.0, 20.0):
        weights = toxicity.fit(rows, np.array(labels, float), twins, counterfactual=strength)
        score = lambda w: weights[columns.of(w)].sum()  # noqa: E731, B023
        gap[strength] = abs(score({"river", "muslim"}) - score({"river", "christian"}))
        assert score({"river", "scum"}) > score({"river"}) + 1
    assert gap[20.0] < 0.2 * gap[0.0]


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    weights = toxicity.train(d, labels, learn=~held)
    rows = toxicity.score(d.where(held), weights).join(labels, "doc_id").select("score", "toxic").toPandas()
    rank, y = rows.score.rank(), rows.toxic
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.95


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (3, None), (4, 0), (None, 1)], "doc_id long, toxic int")
    for weights in (toxicity.train(odd, labels), toxicity.train(odd, labels.limit(0)), toxicity.train(odd, labels.where("toxic = 1"))):
        got = toxicity.score(odd, weights).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, weights).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------


def test_texts_without_letters_are_undetermined(spark):
    rows = [(k, t, "en") for k, t in enumerate(["hello there my friend", "½ ² ③ Ⅷ", "123 _ ٣ !?", "日本", "a²", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, PIECES, langid.train(df, PIECES)).collect()}
    assert [got[k][0] for k in range(6)] == ["en", "und", "und", "en", "en", "und"] and got[1][1] == 0.0
    assert langid.words_of("x²y ⅷ Ab_c") == ["x", "y", "ab", "c"]


def test_forward_sums_all_segmentations():
    vocab = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    probs = np.array([[0.2, 0.3], [0.1, 0.2], [0.3, 0.1], [0.25, 0.3], [0.15, 0.1], [1e-7, 1e-7]])

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for end in range(1, len(word) + 1):
            if word[:end] in vocab:
                total += probs[vocab[word[:end]]] * brute(word[end:])
        if word[0] not in vocab:
            total += probs[5] * brute(word[1:])
        return total

    for w in ("a", "abab", "bxa", "abaabba"):
        assert langid.forward([w, "ab"], vocab, probs)[0] == pytest.approx(np.log(brute(w)), rel=1e-9)
    long = langid.forward(["ab" * 2000], vocab, probs)[0]
    assert np.isfinite(long).all() and long[0] == pytest.approx(2 * langid.forward(["ab" * 1000], vocab, probs)[0][0], rel=1e-3)


def test_languages_held_out(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = langid.train(d, PIECES, learn=~held)
    got = langid.predict(d.where(held), PIECES, model).join(d, "doc_id")
    assert got.where("lang = lang_pred").count() > 0.98 * got.count()
    rows = langid.predict(odd, PIECES, model).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" for r in rows if r.doc_id in (0, 1, 2)) and all(0 <= r.score <= 1 for r in rows)
    assert langid.predict(none, PIECES, model).count() == 0
    empty = langid.train(none, PIECES)
    assert {r.lang_pred for r in langid.predict(odd, PIECES, empty).collect()} == {"und"}
    assert langid.accept(odd, PIECES, model).where("text IS NULL").count() == 0


# -- 9 ---------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            digits = re.sub(r"\D", "", m[0])
            luhn = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(spark, docs, odd, none):
    r = random.Random(4)
    made = ["".join(r.choice(["@", ".", "a", "b1", "+", "+1 ", "5", "55", "555", " ", "-", "4111111111111111", "(", ")", "é", "1.2.3.4", "_", "x@y.com"]) for _ in range(r.randint(1, 40))) for _ in range(400)]
    made += ["9" * 5000, "a@b" + ".c" * 4000, "x" * 50000, "+1" * 20000, "1 " * 3000, "1.2.3.4 " * 600, "00000000000001.2.3.4"]
    texts = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for df in (docs, odd, texts):
        for row in pii.detect(df).collect():
            assert [(s.start, s.rank, s.kind, s.end) for s in row.base] == brute_pii(row.source), row.source[:200]
            assert {(s.kind, s.start, s.end) for s in row.base} <= {(s.kind, s.start, s.end) for s in row.spans}
    assert pii.report(none).count() == 0


def test_candidates_and_redaction(spark):
    text = "call (017) 555-7713 or write joe (at) example (dot) com, card 4111.1111.1111.1111 id=4111.1111.1111.1112 a@b.org"
    df = spark.createDataFrame([(1, text, 5), (2, None, None), (3, "meet me at noon. Bring 12 34 56 78 eggs", 5)], "doc_id long, text string, n_chars long").withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in pii.redact(df, length="n_chars").collect()}
    assert got[1].text == "call [PHONE] or write [EMAIL], card [CARD] id=4111.1111.1111.1112 [EMAIL]"
    assert got[1].n_chars == len(got[1].text) and got[2].text is None and got[3].text == "meet me at noon. Bring 12 34 56 78 eggs" and got[1].source == "s"
    row = pii.report(df.where("doc_id = 1")).first()
    assert (row.n_email, row.n_card, row.n_phone) == (1, 0, 0)
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_pii(text)).encode()).hexdigest()


# -- 10 --------------------------------------------------------------------------------------------------------------


def brute_leaks(rows, items, overlap=13, share=0.8, least=8):
    tokens, out = lambda t: re.findall(r"\w+", (t or "").lower()), set()
    for d, t in rows:
        w = tokens(t)
        for i, u in items:
            b = tokens(u)
            need = min(len(b), overlap)
            if len(b) < least:
                continue
            for g in range(-len(b) + need, len(w) - need + 1):
                same = [b[k] == w[k + g] for k in range(max(0, -g), min(len(b), len(w) - g))]
                if any(sum(same[k : k + need]) >= int(np.ceil(share * need)) for k in range(len(same) - need + 1)):
                    out.add((d, i))
                    break
    return out


def test_leaks(spark, odd, none):
    r = random.Random(6)
    items = [(k, " ".join(f"b{r.randrange(300)}" for _ in range(n))) for k, n in enumerate((40, 30, 20, 15, 10, 8, 5))] + [(7, None), (7, "b1 b2")]
    rows = []
    for k in range(300):
        w = [f"b{r.randrange(300)}" for _ in range(60)]
        if k % 3 == 0:
            part = items[k % 7][1].split()
            if k % 2 and len(part) > 12:  # one token in eight is substituted
                part = [x if j % 8 != 3 else "sub" for j, x in enumerate(part)]
            w[20:20] = part
        rows.append((k, " ".join(w)))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(d, b, block_tokens=50).collect()
    assert {(x.doc_id, x.item_id) for x in got} == brute_leaks(rows, items)
    kept = {x.doc_id for x in decontam.remove(d, b).collect()}
    assert kept == {k for k, _ in rows} - {x.doc_id for x in got}
    assert decontam.leaks(odd, b).count() == 0 and decontam.leaks(none, b).count() == 0 and decontam.leaks(odd, b.limit(0)).count() == 0
    assert decontam.remove(odd, b).columns == odd.columns


def test_long_items_come_in_pieces(spark):
    whole = np.arange(1000, dtype=np.uint64)
    parts = list(decontam.pieces(whole, 13, 100))
    windows = {tuple(p[k : k + 13]) for p in parts for k in range(len(p) - 12)}
    assert max(map(len, parts)) == 100 and windows == {tuple(whole[k : k + 13]) for k in range(988)}
    assert [len(p) for p in decontam.pieces(whole[:5], 13, 100)] == [5]
    text = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, "a " + " ".join(text[k : k + 13]) + " b") for k in range(0, 288, 7)] + [(999, " ".join(reversed(text)))], "doc_id long, text string")
    item = spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")
    found = {r.doc_id for r in decontam.leaks(docs, item, block_tokens=40).collect()}
    assert found == set(range(0, 288, 7)) and {r.doc_id for r in decontam.remove(docs, item, block_tokens=40).collect()} == {999}


def test_every_admitted_pattern_is_hit():
    for n in range(1, 14):
        wrong = n - int(np.ceil(0.8 * n))
        item = np.array([k + 1 for k in range(n)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        index = decontam.Index([("i", item)], 13, 0.8)
        texts = []
        for c in (c for m in range(wrong + 1) for c in itertools.combinations(range(n), m)):
            texts.append(item.copy())
            texts[-1][list(c)] = np.arange(900, 900 + len(c), dtype=np.uint64)
        for got in (index.leaks(texts), [index.leaks([t])[0] for t in texts]):
            assert [(f[0][0], f[0][3] >= n - wrong) for f in got] == [("i", True)] * len(texts)
        over = item.copy()
        over[: wrong + 1] = 7
        assert index.leaks([over, item[:0], item[:-1]]) == [[], [], []]


def test_short_items_and_substitutions_leak(spark):
    r = random.Random(16)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (*range(1, 14), 15, 16)]
    rows = []
    for k in range(600):
        part = items[k % len(items)][1].split()
        for j in r.sample(range(len(part)), min(len(part), r.randrange(5))):
            part[j] = "sub"
        rows.append((k, " ".join(["pad"] * r.randrange(3) + part + ["end"] * r.randrange(3))))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(d, b, least=1).collect()}
    assert got == brute_leaks(rows, items, least=1) and {i for _, i in got} == {i for i, _ in items}
    assert {x.doc_id for x in decontam.remove(d, b, least=1).collect()} == {k for k, _ in rows} - {k for k, _ in got}


def test_nothing_but_the_tokenizer_files_is_read():
    assert json.load(open(BPE))["model"]["type"] == "BPE"
