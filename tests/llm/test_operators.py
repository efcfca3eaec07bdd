"""Every operator against a plain version on documents with every oddity, and on an empty table."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import common, components, exact_dedup, fingerprints, html_extract, licenses, line_dedup, mixing, packing, queries, simhash, token_counts, toxicity

NO_ID = common.NO_ID
SPACE = " \t\n\x0b\x0c\r"
order = lambda i: NO_ID if i is None else i


def collect(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- 7


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(f"[{SPACE}]", "", t or "")].append((-len(t or ""), order(i), i))
    want = []
    for key, members in groups.items():
        keep = min(members)
        sha = hashlib.sha256(key.encode()).hexdigest()
        want += [(i, keep[2], len(members), sha) for _, _, i in members]
    got = exact_dedup.op7_exact_dedup(docs)
    assert collect(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = got.filter("kept")
    assert kept.count() == len(groups) and kept.filter("not (doc_id <=> keep_id)").isEmpty()
    assert exact_dedup.op7_exact_dedup(empty).isEmpty()


def test_heavy_digests_take_the_other_way(spark):
    df = spark.createDataFrame([(k, "copy" if k % 3 else f"t{k}") for k in range(600)], "doc_id long, text string")
    got = exact_dedup.op7_exact_dedup(df)
    assert {r["group_size"] for r in got.filter("doc_id % 3 <> 0").collect()} == {400} and got.filter("kept").count() == 201


def test_lookup_of_many_middling_keys(spark):
    """Thousands of pairs: more keys with two rows than may be broadcast."""
    rows = spark.range(3000).select(F.expr("id div 2").alias("k"), "id").union(spark.range(3000, 3500).select(F.lit(-1).cast("long").alias("k"), "id"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = common.lookup(rows, groups, "k", "n", 3500)
    assert got.count() == 3500 and got.filter("least is null or n is null").isEmpty()
    assert all((t - 1) // common.heavy_from(t) <= common.HEAVY_PARTS for t in range(1, 9000))


def test_misra_gries_keeps_frequent_keys():
    held, truth, rng = {}, Counter(), random.Random(1)
    for _ in range(40):
        batch = Counter(rng.choice(["hot"] * 30 + [f"k{rng.randrange(900)}" for _ in range(70)]) for _ in range(200))
        truth += batch
        held = exact_dedup.merge_counts(held, batch, 20)
    assert len(held) <= 20 and truth["hot"] - sum(truth.values()) / 20 <= held["hot"] <= truth["hot"]


# ---- 5


def plain_lines(rows):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(SPACE))
    holders = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(order(i))
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(holders[key(x)]) < 2 or order(i) == min(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest(), "\n".join(left)))
    return out


def test_line_dedup(docs, rows, empty, monkeypatch):
    want = sorted((x[:4] for x in plain_lines(rows)), key=repr)
    assert collect(line_dedup.op5_line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert line_dedup.op5_line_dedup(empty).isEmpty()
    rebuilt = line_dedup.rebuild(docs)
    assert rebuilt.schema == docs.schema
    assert collect(rebuilt, "doc_id", "text") == sorted(((i, t and left) for (i, t, _), (*_, left) in zip(rows, plain_lines(rows), strict=True)), key=repr)


def test_bitmaps_round_trip():
    for n, drop in ((1, [0]), (9, [0, 8]), (70, list(range(0, 70, 3)))):
        keep = line_dedup.unpack_bits(line_dedup.pack_bits(drop, n), n)
        assert [k for k in range(n) if not keep[k]] == drop
    assert line_dedup.version("é") == line_dedup.version("é") != line_dedup.version("e")


# ---- 9


def plain_targets(sizes):
    """Exact targets by rounds over the open sources: weights 1, 2, 3 by turns in code point order, null last."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: Fraction(1 + k % 3) for k, s in enumerate(names)}
    out, left = {}, Fraction(sum(sizes.values()))
    while len(out) < len(names):
        share = left / sum(weight[s] for s in names if s not in out)
        above = [s for s in names if s not in out and weight[s] * share > 3 * sizes[s]]
        if not above:
            return out | {s: weight[s] * share for s in names if s not in out}
        out |= {s: Fraction(3 * sizes[s]) for s in above}
        left -= sum(3 * sizes[s] for s in above)
    return out


def test_targets(spark):
    rng = random.Random(2)
    many = {f"s{rng.random()}é": rng.choice([0, 1, 5, 10**6, 10**12 + rng.randrange(99)]) for _ in range(500)} | {None: 77, "": 3, "é": 8, "z": 9, "\U0001f600": 10, "\uffee": 11}
    for sizes in ({"b": 100, "a": 10, None: 50, "c": 0}, many, {"x": 0}, {"x": 5}, {None: 4, "a": 10**15}, {}):
        got = mixing.with_targets(spark.createDataFrame(list(sizes.items()), "mix__source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert {r["mix__source"]: (r["target"], r["budget"]) for r in got} == {s: (float(t), int(t)) for s, t in want.items()}


def test_mixing(docs, rows, empty):
    size = lambda t: len(re.findall(f"[^{SPACE}]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    goals = plain_targets(dict(sizes))
    got = mixing.op9_mix_sources(docs).collect()
    by_id = defaultdict(list)
    for i, t, s in rows:
        by_id[i].append((size(t), sizes[s], round(float(goals[s]), 6)))
    assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got if r["doc_id"] is not None) == sorted((i, *x) for i, xs in by_id.items() if i is not None for x in xs)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    full = mixing.mix(docs, mixing.word_count(), ["doc_id", "source"]).collect()
    taken = Counter()
    for r in full:
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(goals[s]) for s in sizes)
    assert collect(mixing.op9_mix_sources(docs.repartition(3)), "doc_id", "size", "taken") == collect(mixing.op9_mix_sources(docs), "doc_id", "size", "taken")
    assert mixing.op9_mix_sources(empty).isEmpty() and mixing.take_documents(empty).isEmpty()


def test_prefix_sums_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "BLOCK_BITS", 2)
    df = spark.createDataFrame([(k, "w " * (k % 7), "ab"[k % 2]) for k in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(df, mixing.word_count(), ["doc_id", "source"]).collect()
    for s in "ab":
        own = sorted((r["before"], r["size"]) for r in got if r["source"] == s and r["size"])
        assert [b for b, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]]))
        assert sum(r["taken"] for r in got if r["source"] == s) == next(r["budget"] for r in got if r["source"] == s)


def test_take_documents_repeats_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", "a", "x"), (1, "a b c d", "a", "x"), (2, "e f", "b", "y"), (3, "g " * 40, "c", "z")], "doc_id long, text string, source string, extra string")
    got = mixing.take_documents(df)
    counts = Counter(r["doc_id"] for r in got.collect())
    assert got.columns == df.columns and counts[2] == 3 and counts[1] >= 2


# ---- 8


def test_packing(docs, rows, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        at = 0
        for k, end in enumerate([first, *range(first + 1024, len(ids) + 1, 1024)]):
            want[i, k, at, end - at, zlib.crc32(ids[at:end].tobytes())] += 1
            at = end
    got = packing.op8_pack(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / 1024 + 2
    assert packing.op8_pack(empty).isEmpty()


def test_shards_meet_again(spark):
    rng = random.Random(2)
    pieces = spark.createDataFrame([(k, 0, 0, rng.randrange(1, 1025), k) for k in range(3000)], packing._COLUMNS)
    got = packing.pack(pieces, 3000, shard=200)
    bins = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    total = pieces.agg(F.sum("length")).first()[0]
    assert got.count() == 3000 and bins.filter("n <> end or n > 1024").isEmpty() and bins.count() <= 1.04 * total / 1024


def squares(lengths, bins):
    return sum(int(lengths[b].sum()) ** 2 for b in bins)


def test_every_step_of_the_search_gains():
    """More than 10,000 steps: each raises the sum of squared fills by what it says, and nothing is lost."""
    rng, steps = np.random.default_rng(4), 0
    for n in (1, 2, 30, 500, 3000):
        for low, high in ((1, 1024), (1, 200), (300, 700), (500, 530)):
            lengths = rng.integers(low, high, n)
            alone = [[k] for k in range(n)]
            shuffled = [b.tolist() for b in np.array_split(rng.permutation(n), n)] if high > 512 else [b.tolist() for b in np.array_split(rng.permutation(n), -(-n // (1024 // high)))]
            for start in (alone, shuffled, packing.best_fit(lengths)):
                gains = []
                done = packing.local_search(lengths, [list(b) for b in start], seen=gains.append)
                assert all(g > 0 for g in gains) and squares(lengths, done) - squares(lengths, start) == sum(gains)
                assert sorted(sum(done, [])) == list(range(n)) and max(lengths[b].sum() for b in done) <= 1024 and len(done) <= len(start)
                steps += len(gains)
    assert steps > 10_000


def test_search_empties_bins_that_best_fit_leaves():
    lengths = np.random.default_rng(1).integers(200, 450, 5000)
    first = packing.best_fit(lengths)
    assert len(packing.local_search(lengths, [list(b) for b in first])) < 0.97 * len(first)


def plain_best_fit(lengths, capacity=1024):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


def test_best_fit_against_a_plain_version():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 400):
        lengths = rng.integers(1, 1025, n)
        assert sorted(1024 - int(lengths[b].sum()) for b in packing.best_fit(lengths)) == plain_best_fit(lengths.tolist())


def test_fast_ids_equal_the_library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for c in range(0, 0x110000, 7):
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}b 1{chr(c)}2 {chr(c)} {chr(c)}{chr(c)}x.{chr(c)}\n{chr(c)} y"
            assert packing.token_ids(s) == lib.encode(s, add_special_tokens=False).ids, hex(c)
    s = "x <|endoftext|>y"
    assert packing.token_ids(s) == lib.encode(s, add_special_tokens=False).ids and 50256 in packing.token_ids(s)
    assert packing._encoder() is not None


def test_the_library_decides_about_ids(monkeypatch):
    """Where the fast way differs on the text that is checked, the library encodes all; where it can't be proved, it always does."""
    texts = ["one", "two words", "three"]
    want = [packing._library_ids(t) for t in texts]
    monkeypatch.setattr(packing, "token_ids", lambda t: [0])
    assert packing.checked_ids(texts) == want and packing.checked_ids([]) == []
    monkeypatch.undo()
    monkeypatch.setattr(packing, "_encoder", lambda: None)
    assert [packing.token_ids(t) for t in texts] == want


# ---- 6


def test_token_counts(docs, rows, empty):
    model, _ = token_counts._model(token_counts.MODEL)
    n = lambda t: len(model.encode(t or ""))
    want = sorted(((i, len((t or "").encode()), n(t), n(t) > 4096) for i, t, _ in rows), key=repr)
    for chunk in (token_counts.CHUNK, 500):
        assert collect(token_counts.token_counts(docs, chunk=chunk), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.op6_token_counts(empty).isEmpty()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, " " * 3000, "x \n" * 900, "日本語テキスト" * 300, "=-" * 1500, "é\U0001f600 " * 400, "<s>" * 800])
def test_huge_texts_without_easy_boundaries(text):
    model, _ = token_counts._model(token_counts.MODEL)
    assert {token_counts.count_huge(text, token_counts.MODEL, c, o) for c, o in ((256, 4), (700, 33))} == {len(model.encode(text))}


# ---- 1


def plain_fingerprint(text):
    """A fingerprint from its definition, bin by bin: only the order in which empty bins look for full ones is taken as given."""
    words = "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall(f"[^{SPACE}]+", words)
    if not words:
        return None
    shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    least = {}
    for x in shingles:
        h = xxhash.xxh3_64_intdigest(x.encode(), 11)
        least[h >> 55] = min(h, least.get(h >> 55, h))
    order = fingerprints._probes(512)
    return [(least[k] if k in least else least[next(j for j in order[k].tolist() if j in least)]) & 15 for k in range(512)]


def test_rows_without_ids_are_spread(spark, tmp_path):
    """A third of a table may have no id: such rows are dealt to shards and ranges like others."""
    rows = [(None if k % 3 else k, 0, 0, 300, 7) for k in range(6000)]
    spark.createDataFrame(rows, packing._COLUMNS).repartition(4).write.parquet(str(tmp_path / "pieces"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "pieces")), 6000, shard=300).collect()
    shards = Counter(r["sequence_id"] >> 32 for r in got)
    assert len(got) == 6000 and max(shards.values()) < 600 and max(Counter(r["sequence_id"] for r in got).values()) == 3
    texts = [(None, f"word {k}", "s") if k % 2 else (k, "other word", "t") for k in range(2000)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    mixed = mixing.mix(df, mixing.word_count(), ["doc_id"]).collect()
    nameless = [r for r in mixed if r["doc_id"] is None]
    # every row has a place of its own in the hash-random order, and the budget is met
    assert sorted(r["before"] for r in nameless) == [2 * k for k in range(1000)] and sum(r["taken"] for r in nameless) == nameless[0]["budget"]


def test_bins_densification_and_packing(rows):
    """Also of texts with few shingles, which leave most bins empty."""
    import base64

    for t in [t for _, t, _ in rows if t is not None] + ["a b c d e f", "x " * 7, " ".join(map(str, range(700))), "É é a\x0bb"]:
        want, got = plain_fingerprint(t), fingerprints.bin_values(t)
        assert (got is None) == (want is None) and (want is None or got.tolist() == want)
        bits = "" if want is None else "".join(f"{v:04b}"[::-1] for v in want)
        assert base64.b64decode(fingerprints.fingerprint(t)) == bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    a, b = plain_fingerprint(rows[8][1]), plain_fingerprint(rows[8][1] + " and some more words at the end of it")
    share = sum(x == y for x, y in zip(a, b, strict=True)) / 512
    assert fingerprints.likeness(np.array(a, "u1"), np.array(b, "u1")) == pytest.approx((share - 1 / 16) / (15 / 16))
    orders = fingerprints._probes(512)
    assert all(sorted(o) == list(range(512)) for o in orders.tolist()[:50]) and len({tuple(o[:4]) for o in orders.tolist()}) > 500


def test_texts_of_megabytes(spark):
    """Every operator on texts of several megabytes, with and without lines and words."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(500_000)]
    long = " ".join(words)
    rows = [(1, long, "a"), (2, long.replace(" ", "\n", 200_000), "a"), (3, "z" * 2_000_000, "b"), (4, long + " end", "b"), (5, "short", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["n_chars"] for r in fingerprints.op1_fingerprints(df).collect()} == {i: len(t) for i, t, _ in rows}
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.op2_simhash(df.filter("doc_id <> 3")).collect()} == {i: f"{simhash.simhash(t):016x}" for i, t, _ in rows if i != 3}
    assert {r["doc_id"] for r in toxicity.score_documents(df, toxicity.Lexicon({" w1 ": 1.0}, set(), (-2.0, 1.0, 0.0, 0.0))).filter("score > 0.3").collect()} == {1, 2, 4}
    want = sorted((x[:4] for x in plain_lines(rows)), key=repr)
    assert collect(line_dedup.op5_line_dedup(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    model, _ = token_counts._model(token_counts.MODEL)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.op6_token_counts(df.filter("doc_id in (1, 5)")).collect()} == {1: len(model.encode(long)), 5: len(model.encode("short"))}
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.op7_exact_dedup(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    packed = packing.op8_pack(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed if r["doc_id"] != 3} == {i: len(packing.token_ids(t)) + 1 for i, t, _ in rows if i != 3}
    assert {r["doc_id"]: r["size"] for r in mixing.op9_mix_sources(df).collect()} == {1: 500_000, 2: 500_000, 3: 1, 4: 500_001, 5: 1}
    assert licenses.op10_licenses(df).filter("n_licenses > 0").isEmpty()
    assert {r["doc_id"] for r in simhash.keep_first(df).collect()} == {1, 3, 5}


def test_fingerprints(docs, rows, empty):
    got = fingerprints.op1_fingerprints(docs).collect()
    ordered = sorted(((order(i), t or "", i) for i, t, _ in rows), key=lambda x: (x[0], x[1].encode()))
    want = []
    for k, (_, t, i) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        a, b, c = (fingerprints.bin_values(x) for x in (t, new, nxt))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(new), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert fingerprints.op1_fingerprints(empty).isEmpty()


def test_one_document_follows_itself(spark):
    r = fingerprints.op1_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0 and r[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_likeness_is_unbiased():
    rng, errors = random.Random(3), []
    for share in (0.02, 0.05, 0.1, 0.3):
        for _ in range(15):
            a = [str(rng.randrange(10**6)) for _ in range(400)]
            b = [x if rng.random() > share else "y" + x for x in a]
            A, B = ({tuple(x[k : k + 5]) for k in range(396)} for x in (a, b))
            errors.append(fingerprints.likeness(*(fingerprints.bin_values(" ".join(x)) for x in (a, b))) - len(A & B) / len(A | B))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05
    assert fingerprints.likeness(*(fingerprints.bin_values(" ".join(str(rng.random()) for _ in range(400))) for _ in "ab")) < 0.1
    v = fingerprints.bin_values("a b c d e f g")
    assert (fingerprints.unpack_values(fingerprints.pack_values(v)) == v).all() and fingerprints.likeness(None, None) == 1.0 and fingerprints.likeness(v, None) == 0.0


# ---- 2


def plain_simhash(t):
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    words = re.findall(f"[^{SPACE}]+", low)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    fps = [plain_simhash(t) for _, t, _ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                label[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), NO_ID), order(i))
    want = sorted(((i, f"{fps[k]:016x}", None if least[find(k)] == NO_ID else least[find(k)]) for k, (i, _, _) in enumerate(rows)), key=repr)
    assert collect(simhash.op2_simhash(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.op2_simhash(empty).isEmpty() and simhash.keep_first(empty).isEmpty()


def gray(x):
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> k
    return x


@pytest.mark.parametrize("width", [1, 2])
def test_index_finds_all_links(width):
    rng = np.random.default_rng(7)
    for _ in range(4):
        found = set()
        for x in rng.integers(0, 2**63, (25, width), dtype="u8").tolist():
            for _ in range(rng.integers(1, 40)):
                y = list(x)
                for k in rng.integers(0, 64 * width, rng.integers(0, 5)):
                    y[k // 64] ^= 1 << int(k % 64)
                found.add(tuple(y))
                x = y if rng.random() < 0.4 else x
        f = np.array(sorted(found, key=lambda t: tuple(map(gray, t))), "u8")
        n = len(f)
        near = np.array([np.bitwise_count(f[i] ^ f).sum(axis=1) <= 4 for i in range(n)])
        label = np.arange(n)
        while True:
            new = np.array([label[near[i]].min() for i in range(n)])
            if (new == label).all():
                break
            label = new
        assert (simhash.link_sorted(f, np.zeros(n, "i8")) == label).all()


def test_the_index_prunes_no_link():
    """Sets of every size at a similarity of 0.8 or a little more differ in fewer bits than the index prunes at."""
    rng, most = np.random.default_rng(3), 0
    for n in (4, 5, 6, 8, 9, 10, 13, 20, 45, 90, 300, 900):
        for _ in range(150):
            union = rng.integers(0, 2**63, n, dtype="u8")
            gone = int(0.2 * n)
            cut = int(rng.integers(0, gone + 1))
            a, b = union[cut:], np.concatenate([union[:cut], union[gone:]])
            assert len(np.intersect1d(a, b)) >= 0.8 * n
            x, y = simhash.wide_fingerprint(a), simhash.wide_fingerprint(b)
            most = max(most, int(np.bitwise_count(x ^ y).sum()))
    assert 90 < most <= simhash.wide_distance(0.8) < 150


def test_the_closer_bound_prunes_no_link():
    """Sets of MANY shingles or more at 0.8 are within the bound that is for them, most of those at 0.5 are not."""
    rng = np.random.default_rng(15)
    bound, far = simhash.wide_distance(0.8, shingles=simhash.MANY), []
    assert bound < simhash.wide_distance(0.8)
    for n in (80, 100, 300, 900):
        for _ in range(200):
            union, gone = rng.integers(0, 2**63, n, dtype="u8"), int(0.2 * n)
            cut = int(rng.integers(0, gone + 1))
            a, b = union[cut:], np.concatenate([union[:cut], union[gone:]])
            assert min(len(a), len(b)) >= simhash.MANY and len(np.intersect1d(a, b)) >= 0.8 * n
            apart = lambda x, y: int(np.bitwise_count(simhash.wide_fingerprint(x) ^ simhash.wide_fingerprint(y)).sum())
            assert apart(a, b) <= bound
            far.append(apart(union[: 3 * n // 4], union[n // 4 :]))
    assert np.mean(np.array(far) > bound) > 0.9


def test_choices_are_complete():
    for blocks in (6, 7, 9):
        masks = simhash.choices(blocks)
        for bits in ([0, 20, 40, 63], [1, 2, 3, 4], [10, 30, 50]):
            assert any(not m & sum(1 << b for b in bits) for m in masks)
    assert simhash.blocks_for(10) == 6 and simhash.blocks_for(10**11) > 6


def test_hot_buckets_are_split(spark):
    rng, found = np.random.default_rng(8), set()
    for base in rng.integers(0, 2**63, 3).tolist():
        for _ in range(300):
            x = base
            for k in rng.integers(0, 30, rng.integers(0, 4)):
                x ^= 1 << int(k)
            found.add(x)
    found |= set(rng.integers(0, 2**63, 200).tolist())
    fps = spark.createDataFrame([(x, x) for x in found], "node long, w0 long")
    masks = [[m] for m in simhash.choices(6)]
    whole, cut = ({r["u"]: r["m"] for r in components.components(simhash.link_fingerprints(fps, masks, 4, limit)).collect()} for limit in (1 << 18, 64))
    assert whole == cut and len(set(whole.values())) >= 3


def test_a_task_searches_few_buckets_at_once(monkeypatch):
    """Whole buckets are searched in runs of bounded length, a longer bucket alone; links are those of each bucket."""
    rng, sizes = np.random.default_rng(15), [1, 1, *[700] * 50, 17_000, 3, 1, 900]
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    fp = rng.integers(0, 2**16, (len(bucket), 1), dtype="u8") << np.uint64(20)
    order = np.lexsort([gray(fp[:, 0]), bucket])
    fp, node = fp[order], rng.permutation(len(bucket))
    want = []
    for k in range(len(sizes)):
        own = np.flatnonzero(bucket == k)
        ends = simhash.link_sorted(fp[own], bucket[own], 1)
        want += [(int(node[own[i]]), int(node[own[e]])) for i, e in enumerate(ends) if i != e]
    real, calls = simhash.link_sorted, []
    monkeypatch.setattr(simhash, "link_sorted", lambda f, b, *more: calls.append(np.unique(b, return_counts=True)[1]) or real(f, b, *more))
    rows = [pa.record_batch([pa.array(x[k : k + 5000]) for x in (bucket, node, fp[:, 0].view("i8"))], names=["bucket", "node", "w0"]) for k in range(0, len(bucket), 5000)]
    got = [(u, v) for batch in simhash._links(1, 1 << 18)(iter(rows)) for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True)]
    assert sorted(got) == sorted(want) and len(got) > 1000
    assert all(len(c) == 1 or c.sum() <= 1 << 14 for c in calls) and sum(c.sum() for c in calls) == sum(s for s in sizes if s > 1)


def test_long_sets_are_compared_in_little_memory():
    """Sets of 8000 shingles, two of each alike by 0.9 and all within the index's bound: pairs are linked, no Python sets are held."""
    rng = np.random.default_rng(16)
    shared, sets = rng.integers(0, 2**63, 6400, dtype="u8"), []
    for _ in range(20):
        own = rng.integers(0, 2**63, 1600, dtype="u8")
        sets += [np.sort(np.append(shared, own)), np.sort(np.concatenate([shared, own[:-400], rng.integers(0, 2**63, 400, dtype="u8")]))]
    words = np.array([simhash.wide_fingerprint(x) for x in sets]).view("i8")
    assert (np.bitwise_count((words[0] ^ words).view("u8")).sum(axis=1, dtype="i4") <= simhash.wide_distance(0.8, shingles=simhash.MANY)).sum() > 20
    node = np.arange(40)
    rows = pa.record_batch([pa.array(node * 0), pa.array(node), pa.array(node), *(pa.array(words[:, k]) for k in range(simhash.WIDE)), pa.array([x.tobytes() for x in sets])], names=["bucket", "node", "of", *simhash.WORDS_OF, "shingles"])
    tracemalloc.start()
    try:
        found = next(simhash._search_alike(0.8)(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(zip(found["v"].to_pylist(), found["u"].to_pylist(), strict=True)) == [(2 * k, 2 * k + 1) for k in range(20)]
    assert peak < 12e6


def test_components(spark):
    rng, edges = random.Random(9), []
    for c in range(40):
        nodes = [c * 1000 + k for k in range(rng.randrange(2, 30))]
        edges += [(nodes[k], nodes[rng.randrange(k)]) for k in range(1, len(nodes))]
    edges += [(10**6 + k, 10**6 + k + 1) for k in range(100)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r["u"]: r["m"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {u: (u // 1000 * 1000 if u < 10**6 else 10**6) for e in edges for u in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_components_write_no_file_a_partition(spark, monkeypatch):
    """Few pairs are few files, however many partitions there are, and pairs that are stars by now need no further round."""
    files = []

    def noted(df, name):
        done = common.scratch(df, name)
        files.append(len(done.inputFiles()))
        return done

    monkeypatch.setattr(components, "scratch", noted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        stars = spark.createDataFrame([(1000 * c + k, 1000 * c) for c in range(40) for k in range(1, 9)] * 2, "u long, v long")
        got = {(r["u"], r["m"]) for r in components.components(stars).collect()}
        assert got == {(1000 * c + k, 1000 * c) for c in range(40) for k in range(9)}
        assert files == [1]
        paths = spark.createDataFrame([(100 * c + k, 100 * c + k + 1) for c in range(1000) for k in range(9)], "u long, v long")
        got = {(r["u"], r["m"]) for r in components.components(paths).collect()}
        assert got == {(100 * c + k, 100 * c) for c in range(1000) for k in range(10)}
        assert len(files) > 2 and max(files) == 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_keep_first(docs, rows):
    got = simhash.keep_first(docs)
    ids = [r["doc_id"] for r in got.collect()]
    assert got.schema == docs.schema
    assert len([i for i in ids if i in (0, 1, 2, 6)]) == 1 and len([i for i in ids if i in (-5, 76, 77, 2**62)]) == 1
    assert not {50, 51, 52} & set(ids) and len([i for i in ids if i == 70]) <= 1
    lone = [10 + k for k in range(8, 30)]
    assert set(lone) <= set(ids)


def test_keep_first_keeps_one_of_each_group(spark):
    """Groups of null ids alone, and groups led by one doc_id with several texts, are groups of their own."""
    rng = random.Random(4)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(60))
    lone = [text() for _ in range(40)]
    rows = [(None if k < 30 else 7, t) for k, t in enumerate(lone)] + [(None, lone[0]), (9, lone[35]), (None, lone[36])]
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted(rows[:40], key=repr)


def test_near_copies_are_found_at_the_threshold(spark):
    rng, rows = random.Random(11), []
    for k in range(120):
        a = [str(rng.randrange(10**6)) for _ in range(300)]
        b = list(a)
        for at in rng.sample(range(300), 3):  # 15 of 296 shingles: similarity 0.9
            b[at] = "new"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.like_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(120)) >= 114 and all(got[2 * k] == 2 * k for k in range(120))


def test_like_documents_come_through_the_index(spark, monkeypatch):
    """Only what the Gray-order index links is a candidate, also where fingerprints are dealt to many buckets."""
    rng, rows = random.Random(13), []
    for k in range(200):
        a = [str(rng.randrange(10**6)) for _ in range((8, 40, 300)[k % 3])]
        b = a + ["new"] if k % 3 < 2 else a[:100] + ["new"] * 8 + a[108:]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "CROWD", 32)
    assert len(simhash.samples(400)) > 10
    got = {r["doc_id"]: r["component_id"] for r in simhash.like_documents(df).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(200)) >= 198 and all(got[2 * k] == 2 * k for k in range(200))
    monkeypatch.setattr(simhash, "link_fingerprints", lambda fps, *_, **__: fps.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0))
    assert all(r["doc_id"] == r["component_id"] for r in simhash.like_documents(df).collect())


def test_pairs_at_the_likeness_share_a_bucket():
    """Four shingles of five, which differ most, and 80 of 100 meet; unlike sets of any size don't come near."""
    rng = np.random.default_rng(14)
    sets = lambda n: rng.integers(0, 2**63, n, dtype="u8")
    for n in (1, 4096, 20_000, 10**6):
        masks = np.array(simhash.samples(n), "u8")
        assert n / 2 ** int(np.bitwise_count(masks).sum(axis=1).min()) <= simhash.CROWD
        met = 0
        for k in range(600):
            union = sets(5) if k % 2 else sets(100)
            x, y = simhash.wide_fingerprint(union), simhash.wide_fingerprint(union[len(union) // 5 :])
            met += bool((((x ^ y) & masks) == 0).all(axis=1).any())
        assert met >= 597, n
    bound = simhash.wide_distance(0.8, simhash.HELD)
    for size in (1, 2, 3, 4, 6, 10, 100):
        fps = np.array([simhash.wide_fingerprint(np.sort(sets(size)))[: simhash.HELD] for _ in range(150)])
        apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype="i4")
        assert abs(apart.sum() / 150 / 149 - 32 * simhash.HELD) < 2 and (apart > bound).sum() == 150 * 149


def test_like_documents_against_brute_force(spark):
    """Long and short texts around the threshold, and a large group of near copies: links are those of the shingle sets."""
    rng, rows = random.Random(12), []
    word = lambda: str(rng.randrange(10**6))
    for n, edits, pairs in ((300, 7, 90), (300, 8, 60), (300, 9, 40), (44, 1, 50), (8, 0, 20), (9, 0, 20), (13, 0, 20)):
        for _ in range(pairs):
            a = [word() for _ in range(n)]
            b = list(a) if edits else a + [word() for _ in range(1 if n < 13 else 3)]
            for at in rng.sample(range(2, n - 2), edits):
                b[at] = word()
            rows += [a, b]
    base = [word() for _ in range(120)]
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(4)):
            copy[at] = word()
        rows.append(copy)
    sets = [{tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for x in rows]
    like = {(a, b): s for b in range(len(rows)) for a in range(b) if (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.6}
    label = list(range(len(rows)))
    for (a, b), s in like.items():
        if s >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.like_documents(df).collect()}
    edge = [p for p, s in like.items() if 0.8 <= s < 0.85]
    below = [p for p, s in like.items() if s < 0.8 and label[p[0]] != label[p[1]]]
    linked = sum(got[a] == got[b] for a, b in edge)
    print("pairs at 0.80 to 0.85:", len(edge), "linked:", linked, "below and not connected:", len(below), "linked:", sum(got[a] == got[b] for a, b in below))
    assert len(edge) > 50 and len(below) > 50
    assert linked >= 0.98 * len(edge) and not any(got[a] == got[b] for a, b in below)
    assert sum(got[k] != label[k] for k in range(len(rows))) <= 0.02 * len(rows)


# ---- 3


def test_fold():
    f = lambda s: toxicity.fold(s).split()
    assert f("ID1OT 1d10t ıdiot") [:2] == ["idiot", "idiot"] and f("ѕсum $cum 5cum!") == ["scum"] * 3 and f("b2b 100 3d") [1] == "100"
    assert toxicity.fold("") == toxicity.fold(" .,") == " " or toxicity.fold("").strip() == ""
    assert f("Crème​brûlée ＦＯＯ") == ["cremebruiee", "foo"]


def test_lexicon_and_exceptions():
    lex = toxicity.Lexicon({" bad ": 3.0, " wor": 2.0}, {" bad iuck "}, (-2.0, 1.0, 0.0, 0.0))
    assert list(lex.matches(toxicity.fold("a bad worse thing")).values()) == [" bad ", " wor"]
    assert lex.matches(toxicity.fold("just bad luck")) == {} and lex.score("bad") > lex.score("") == lex.score(None)
    assert toxicity.Lexicon({}, set()).matches(" a ") == {}


def plain_matches(lexicon, folded):
    """Every place of every entry by search; the weightiest entry of a place counts, none that starts inside an exception phrase."""
    places = lambda x: [k for k in range(len(folded)) if folded.startswith(x, k)]
    best = {}
    for entry, weight in lexicon.weights.items():
        for k in places(entry):
            if k not in best or weight > lexicon.weights[best[k]]:
                best[k] = entry
    spared = {j for p in lexicon.phrases for k in places(p) for j in range(k, k + len(p) - 1)}
    return {k: e for k, e in best.items() if k not in spared}


def test_matching_against_a_naive_search():
    rng, hits = random.Random(7), 0
    words = ["".join(rng.choice("abi") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    for _ in range(60):
        entries = {(f" {w} " if rng.random() < 0.5 else f" {w}"): rng.random() + 0.1 for w in rng.sample(words, 8)}
        phrases = {f" {rng.choice(words)} {rng.choice(words)} " for _ in range(30)}
        lexicon = toxicity.Lexicon(entries, phrases)
        for _ in range(20):
            folded = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))))
            want = plain_matches(lexicon, folded)
            got = lexicon.matches(folded)
            assert got.keys() == want.keys() and all(entries[got[k]] == entries[want[k]] for k in want)
            hits += len(want)
    assert hits > 500


def test_held_out_accuracy(spark):
    """On the given tables: hardly a clean document is called toxic, and those with words that training rows tell are found (the
    others hold none of any entry)."""
    for sf, recall in (("sf0.01", 0.6), ("sf0.1", 0.8)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        got = toxicity.op3_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
        n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
        print(sf, n)
        assert n.get((1, 1), 0) >= recall * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.005 * n[0, 0]


def test_scores_beside_clashing_columns(spark, docs, labels):
    clash = docs.withColumn("score", F.lit("x")).withColumn("score_", F.lit(1))
    got = toxicity.score_documents(clash.select("doc_id", "text", "score", "score_"), toxicity.Lexicon({" bad ": 3.0}, set(), (-2.0, 1.0, 0.0, 0.0)))
    assert got.columns == ["doc_id", "text", "score", "score_", "score__"] and got.filter("score__ is null").isEmpty()
    wide = labels.withColumns({c: F.lit("y") for c in ("text", "score", "entry", "n", "id", "toxic_", "held_out")})
    assert toxicity.op3_toxicity(clash, wide).count() == docs.count() and toxicity.keep_clean(clash, wide).columns == clash.columns


def test_toxicity_learns_from_training_folds_only(spark):
    rng, rows, marks = random.Random(1), [], []
    insult = {False: "grumblenaut", True: "heldoutword"}
    for k in range(1200):
        held, toxic = zlib.crc32(str(k).encode()) % 4 == 2, k % 5 == 0
        words = [f"w{rng.randrange(400)}x" for _ in range(60)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice([insult[False], "snarlface", "SnarlFaces", "gr0mblen@ut".replace("0", "u")])
            if held:
                words[0] = insult[True]
        rows.append((k, " ".join(words), "en", "s"))
        marks.append((k, 0, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    lex = toxicity.learn(df, lab)
    assert not any("heidout" in k for k in lex.weights)
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(df, lab).collect()}
    right = [got[k]["predicted"] == int(k % 5 == 0) for k in got if got[k]["held_out"]]
    assert np.mean(right) > 0.98 and sum(r["held_out"] for r in got.values()) == sum(zlib.crc32(str(k).encode()) % 4 == 2 for k in range(1200))
    kept = toxicity.keep_clean(df, lab)
    assert kept.columns == df.columns and abs(kept.count() - 960) < 15


def test_toxicity_on_odd_rows(docs, rows, empty, labels, spark):
    got = toxicity.op3_toxicity(docs, labels)
    assert got.count() == len(rows) and got.filter("score is null or score < 0 or score > 1 or held_out is null").isEmpty()
    assert toxicity.op3_toxicity(empty, labels).isEmpty()
    bare = toxicity.op3_toxicity(docs, labels.limit(0))
    assert bare.agg(F.max("predicted")).first()[0] == 0
    assert toxicity.keep_clean(docs, labels).schema == docs.schema


# ---- 4

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a><li>Menu</ul></nav><!-- c --><div class="ad-box">Buy</div><div id="page"><article class="post"><header><h1>Title &amp; more</h1></header>
<p>First <b>bold</b>
 words&nbsp;here<p>Second<br>line</p><ul><li>one<li>two</ul><aside>side</aside><div class="cookie-notice">Cookies</div><form><input>Mail</form><pre>a  b</pre>5 &lt; 6 &#233; &hellip;
<section id="comments"><p>Reader says</p></section></article></div><footer>Foot</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE).split("\n") == ["Title & more", "First bold words here", "Second", "line", "one", "two", "a b", "5 < 6 é …"]
    assert html_extract.main_text("") == "" and html_extract.main_text("bare &amp; text") == "bare & text"
    assert html_extract.main_text("<p>a<table><tr><td>1<td>2</table><p>b <unclosed") == "a\n1\n2\nb <unclosed"
    assert html_extract.main_text("<article>x<script>if (a<b) y</script>z") == "xz" and html_extract.main_text("<div class='nav'>only</div>") == ""
    assert html_extract.main_text("<p>" * 3000 + "deep") == "deep" and html_extract.main_text("<div>" * 3000 + "deep") == "deep"


def host_pages(n, host="site.example", menu=6, seed=3):
    """Pages without telling tags or classes: a menu that differs in one entry a page, a notice of other words each time,
    a story of paragraphs, a footer."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for k in range(n):
        story = [" ".join(word() for _ in range(rng.randrange(3, 60))) for _ in range(rng.randrange(2, 12))]
        entries = [f"Menu entry {m}" for m in range(menu) if m != k % menu] + [word()]
        lists = "".join(f"<li><a href='/{m}'>{e}</a>" for m, e in enumerate(entries))
        body = "".join(f"<p>{p}" for p in story)
        page = f"<body><div class=x1><ul>{lists}</ul></div><div class=x2>{word()} {word()} {word()}</div><div class=x3><h1>{story[0][:20]}</h1>{body}</div><div class=x4>Site of {word()}</div></body>"
        out.append((k, f"https://{host}/{k}", page, "\n".join([story[0][:20].strip(), *story])))
    return out


def test_style_tree_alone_finds_the_story(spark):
    """No mark tells anything: what stays is the tree's work, and without the tree everything stays."""
    rows = host_pages(60) + [(100 + k, u.replace("site", "other"), h, t) for k, u, h, t in host_pages(25, seed=8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wanted string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df, weigh=False).collect()}
    assert got == {k: t for k, _, _, t in rows}
    assert not any(html_extract.main_text(h, weigh=False) == t for _, _, h, t in rows)


def test_style_tree_on_the_given_pages(spark):
    """The tree alone is right wherever a host has some pages; the weights alone are, too."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    held = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    want = {k: html_extract.main_text(f"<article>{m[1]}</article>") if (m := re.search("<article>(.*)</article>", h, re.S)) else "" for k, h in held.items()}
    for weigh in (True, False):
        got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages, weigh).collect()}
        assert got == want, weigh
        assert weigh or all(html_extract.main_text(h, weigh=False) != want[k] for k, h in held.items())


def plain_tree(pages):
    """Entropy and importance of every host's nodes by their definitions, from lists of what pages show."""
    shapes, found, told = defaultdict(list), defaultdict(list), {}
    for host, page in pages:
        read = html_extract.Page(page)
        for node, (ups, weight, children) in read.nodes.items():
            shapes[host, node].append(tuple(children))
            told[host, node] = (ups, weight)
        for node, text in set(read.blocks):
            found[host, node].append(text)
    bits = {}
    for key, seen in shapes.items():
        if len(seen) > 1:
            share = [n / len(seen) for n in Counter(seen).values()]
            bits[key] = -sum(p * np.log2(p) for p in share)
    out = {}
    for (host, node), b in bits.items():
        n, texts = len(shapes[host, node]), found.get((host, node))
        content = importance = None
        if texts:
            often = Counter(texts)
            content = np.mean([1 - np.log2(often[t]) / np.log2(n) for t in texts])
            ups, weight = told[host, node]
            region, top = max(bits[host, x] for x in (*ups, node)), max(v for (h, _), v in bits.items() if h == host)
            lively = (region + 0.25) / (top + 0.25)
            importance = weight * ((n - 1) * (0.25 + 0.75 * content) * lively + 4 * 0.5) / (n - 1 + 4)
        out[host, node] = (n, b, content, importance)
    return out


def test_entropy_and_importance(spark):
    rows = [(u.split("/")[2], h) for _, u, h, _ in host_pages(30) + host_pages(9, "b.example", 3, 5)] + [("c.example", PAGE), ("c.example", PAGE), ("d.example", PAGE), ("", "")]
    rows += [("e.example", f"<p>one<div class='ad'>two {k % 2}</div><article><p>three {k}</article>") for k in range(7)]
    want = plain_tree(rows)
    got = {(r["host"], r["node"]): (r["pages"], r["bits"], r["content"], r["importance"]) for r in html_extract.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    for k, x in want.items():
        assert all((a is None and b is None) or abs(a - b) < 1e-6 for a, b in zip(got[k], x, strict=True)), (k, got[k], x)


def test_style_tree_removes_what_a_host_repeats(spark):
    rows = [(k, f"https://u@Site.example:80/{k}", f"<body><div class=top>Welcome to the site</div><div class=text><p>Story {k} of its own</p></div><div class=note2>Same words {k % 2}</div>") for k in range(40)]
    rows += [(100, "http://lone.example/", rows[0][2]), (101, None, None), (102, "junk", ""), (0, "https://site.example/0", rows[0][2]), (None, "https://site.example/0", rows[1][2])]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({c: F.lit("x") for c in ("host", "node", "text", "n_chars", "nodes", "worth", "weight")})
    got = {(r["page_id"], r["url"]): r for r in html_extract.op4_html_extract(df).collect()}
    assert got[7, "https://u@Site.example:80/7"]["text"] == "Story 7 of its own" and got[None, "https://site.example/0"]["text"] == "Story 1 of its own"
    assert got[100, "http://lone.example/"]["text"].startswith("Welcome") and got[101, None]["text"] == "" and got[101, None]["n_chars"] == 0 and len(got) == 45


def test_very_long_pages(spark):
    long = "<p>" + "word &amp; " * 400_000 + "</p>"
    rows = [(1, "http://h/1", f"<article>{long}</article><nav>menu</nav>"), (2, "http://h/2", "<div>" * 100_000 + "deep" + "</div>" * 100_000), (3, "http://h/3", "<ul><li>" * 2000 + "x")]
    got = {r["page_id"]: r["text"] for r in html_extract.op4_html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("word & " * 400_000).strip() and got[2] == "deep" and got[3] == "x"


def test_article_copies_stay(spark):
    rows = [(k, "http://h.example/x", "<article><h1>One story</h1><p>told again</p></article>") for k in range(30)]
    got = html_extract.op4_html_extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in got.collect()} == {"One story\ntold again"}
    assert html_extract.op4_html_extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


# ---- 10


def plain_grams(line, m):
    runs, run = [], []
    for w in [*licenses.words_of(line), None]:
        if w in set(m.words):
            run.append(w)
        else:
            runs.append(run)
            run = []
    return {g for r in runs for g in licenses.grams_of(r) if g in set(m.grams)}


def plain_licenses(text, m):
    out = []
    for k, part in enumerate(re.split(licenses._PARAGRAPH, text or "")):
        found = plain_grams(part, m)
        if not found:
            continue
        logits = m.bias + sum(np.round(m.weights[m.grams.index(g)], 6) for g in found)
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        family = m.classes[int(p.argmax())]
        shares = [len(found & set(gs)) / len(gs) for f, gs in m.templates if f == family]
        if family != licenses.UNKNOWN and p.max() >= licenses.PROBABILITY and max(shares) >= licenses.CONFIRMED:
            out.append((k, family))
    return out


def test_licenses(spark, docs, rows, empty):
    m = licenses.model()
    assert m.accuracy > 0.6  # on templates that the fit did not see
    own = [(f, t) for f, t in licenses.TEMPLATES]
    texts = [(1000 + k, f"Some prose here.\n{t}\nMore.") for k, (_, t) in enumerate(own)] + [(2000 + k, t) for k, t in enumerate(licenses.OTHER)]
    texts += [(3000, "Release 2 under the MIT license, the general public said"), (3001, "ÉLicensed under CC BY-SA 3.0.é"), (3002, "licensed UNDER the gnu GENERAL public license, Version 2.\nReleased under the MIT License.")]
    texts += [(i, t) for i, t, _ in rows]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(((i, len(re.split(licenses._PARAGRAPH, t or "")), len(f := plain_licenses(t, m)), f[0][1] if f else None, ",".join(sorted({x for _, x in f})), f[0][0] if f else None) for i, t in texts), key=repr)
    assert collect(licenses.op10_licenses(df), "doc_id", "n_paragraphs", "n_licenses", "family", "families", "paragraph") == want
    got = {r["doc_id"]: r for r in licenses.op10_licenses(df).collect()}
    assert sum(got[1000 + k]["family"] == f for k, (f, _) in enumerate(own)) >= 0.95 * len(own)
    assert not any(got[2000 + k]["n_licenses"] for k in range(len(licenses.OTHER))) and got[3002]["families"] == "GPL,MIT"
    assert licenses.op10_licenses(docs).count() == len(rows) and licenses.op10_licenses(empty).isEmpty()


#: As licences are declared in documents; none is a template.
DECLARED = [
    ("MIT", "The MIT License"), ("MIT", "This library is distributed under the MIT License."), ("MIT", "It is under an MIT license"), ("MIT", "Code released under the MIT License. See LICENSE for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction"),
    ("Apache", "Licensed under the Apache License, Version 2.0 (the License);"), ("Apache", "This file is licensed to you under the Apache License, Version 2.0"), ("Apache", "Apache License 2.0"),
    ("GPL", "GNU GPL v3 or later"), ("GPL", "This program is licensed under the GNU General Public License, version 2, or any later version."), ("GPL", "You should have received a copy of the GNU General\nPublic License along with this program. If not, see the site."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 3"), ("AGPL", "The server is licensed under the GNU Affero General Public License, version 3 or later."),
    ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"), ("BSD", "This code is released under the BSD 3-Clause License"), ("BSD", "Licensed under the BSD 2-Clause License."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"), ("ISC", "Licensed under the ISC license"),
    ("BSL", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)"), ("BSL", "Boost Software License - Version 1.0 - August 17th, 2003"), ("EPL", "made available under the Eclipse Public License v2.0"), ("EUPL", "Licensed under the EUPL v1.2 or later"), ("Zlib", "This library is released under the zlib license"),
    ("CC-BY", "This article is licensed under a Creative Commons Attribution 3.0 International License"), ("CC-BY-SA", "Text is available, licensed under CC BY-SA 3.0"), ("CC-BY-NC", "Licensed under CC BY-NC 4.0"), ("CC-BY-ND", "Photos licensed under CC BY-ND 2.0"),
    ("Public-Domain", "Released under CC0 1.0 Universal"), ("Public-Domain", "This text is in the public domain"), ("Proprietary", "Copyright (c) 2019 Jane Doe. All rights reserved."), ("Proprietary", "All rights reserved."), ("Proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
]
#: Prose that declares nothing; none is among the model's.
PROSE = [
    "He renewed his fishing license in May.", "The general said that the public had a right to know.", "Professors from MIT and Apache County met.", "The permission slip must be signed by a parent.", "You may copy the recipe, free of charge, from the board.",
    "The foundation published a list of conditions for the prize.", "Creative writing needs attention and international readers.", "A boost to the economy is expected by the bank.", "The version of the story that she told was 2.0 times longer.", "All seats reserved for guests.",
    "Copyright law is hard to understand.", "The domain is public knowledge.", "Distributed systems are hard; software fails.", "The source of the river is in the forms of two lakes.", "Any person with a driver's license may apply under the terms given.",
]


def test_license_recall_and_precision(spark):
    """On lines as documents hold them, unseen by the fit: recall and precision, wrapped lines too."""
    rows = [(k, f"Some story that ends.\n{t}\n\nAnd it goes on.") for k, (_, t) in enumerate(DECLARED)] + [(1000 + k, t) for k, t in enumerate(PROSE)]
    got = {r["doc_id"]: r["families"] for r in licenses.op10_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right, false = sum(got[k] == f for k, (f, _) in enumerate(DECLARED)), sum(bool(got[1000 + k]) for k in range(len(PROSE)))
    print("declared", len(DECLARED), "right", right, [(f, got[k], t) for k, (f, t) in enumerate(DECLARED) if got[k] != f], "prose with a licence", [PROSE[k] for k in range(len(PROSE)) if got[1000 + k]])
    assert right >= 0.9 * len(DECLARED) and not false


def test_licenses_on_the_given_documents(spark):
    """All planted lines of sf0.01, whatever lines lie around them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = {"GPL": "This work is licensed under the GNU General Public License, version", "Proprietary": "All rights reserved.", "CC-BY-NC": "Licensed under CC BY-NC", "MIT": "Released under the MIT License.", "Apache": "Licensed under the Apache License, Version"}
    want = {r["doc_id"]: ",".join(sorted(f for f, t in told.items() if t in (r["text"] or ""))) for r in docs.collect()}
    got = {r["doc_id"]: r["families"] for r in licenses.op10_licenses(docs).collect()}
    assert got == want and sum(map(bool, want.values())) >= 20


def test_repeats_are_combined_before_the_shuffle(spark):
    """Many rows of one null id and one text are one hot group only if they are shuffled row by row."""
    df = spark.createDataFrame([(None, "Released under the MIT License.")] * 300 + [(1, "x")], "doc_id long, text string")
    assert {r["n_licenses"] for r in licenses.op10_licenses(df).collect()} == {0, 1}
    plan = licenses.paragraphs(df)._jdf.queryExecution().executedPlan().toString()
    assert re.search("Aggregate.*Exchange.*partial_max", plan, re.S)


def test_license_plan_is_native(docs):
    plan = licenses.op10_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# ---- pipeline and registry


def test_pipeline_on_odd_rows(spark, docs, empty, labels, tmp_path):
    for name, df in (("some", docs), ("none", empty)):
        d = tmp_path / name
        df.write.parquet(str(d / "documents.parquet"))
        labels.write.parquet(str(d / "labels.parquet"))
        held = spark.read.parquet(str(d / "documents.parquet"))
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            after = f(spark, held, str(d))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == held.columns, stage
            after.write.parquet(str(d / stage))
            held = spark.read.parquet(str(d / stage))
        assert held.count() == corpus_pipeline.run(spark, str(d)).count() and (held.count() > 0) == (name == "some")


def test_stages_against_plain_versions(spark, sf_dir):
    """Each stage on all that its predecessor kept, held against a plain version of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    lexicon = toxicity.learn(docs, labels)
    clean = [r for r in rows if lexicon.score(r[1]) < toxicity.THRESHOLD]
    stages = dict(corpus_pipeline.STAGES)
    held = common.scratch(stages["toxicity"](spark, docs, sf_dir), "a")
    assert collect(held, "doc_id", "text") == sorted((x[:2] for x in clean), key=repr)
    held = common.scratch(stages["line_dedup"](spark, held, sf_dir), "b")
    lines = [(x[0], x[4]) for x in plain_lines(clean)]
    assert collect(held, "doc_id", "text") == sorted(lines, key=repr)
    before = [(r["doc_id"], r["text"]) for r in held.collect()]
    sets = {i: frozenset(fingerprints.shingle_spans(t, 5)[0][a:b] for a, b in zip(*fingerprints.shingle_spans(t, 5)[1:], strict=True)) for i, t in before}
    held = common.scratch(stages["near_duplicates"](spark, held, sf_dir), "c")
    kept = {r["doc_id"] for r in held.collect()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
    near = {i: [j for j in sets if j != i and like(i, j) >= 0.8] for i in sets}
    assert all(i in kept for i in sets if not near[i])  # no false drop
    assert not any(i in kept and j in kept for i in sets for j in near[i]) and any(near.values())
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in near[i]:
            low, high = sorted((label[i], label[j]))
            label = {k: low if x == high else x for k, x in label.items()}
    assert kept == set(label.values())  # the smallest doc_id of each group
    left = [(r["doc_id"], r["text"], r["source"]) for r in held.collect()]
    mixed = common.scratch(stages["mixing"](spark, held, sf_dir), "d")
    size = lambda t: len((t or "").split())
    sizes, taken, biggest = Counter(), Counter(), Counter()
    for _, t, s in left:
        sizes[s] += size(t)
        biggest[s] = max(biggest[s], size(t))
    for r in mixed.collect():
        taken[r["source"]] += size(r["text"])
    goals = plain_targets(dict(sizes))
    assert all(abs(taken[s] - goals[s]) <= biggest[s] / 2 + 1 for s in sizes)
    packed = stages["packing"](spark, mixed, sf_dir)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(packing.token_ids(r["text"] or "")) + 1 for r in mixed.collect())


def test_registry(spark, sf_dir):
    import __spark_entry__

    found = [q for q in __spark_entry__.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in found) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    df = queries.queries()[name](spark, sf_dir)
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert collect(df, *cols) == sorted(con.sql(queries.oracle_sql()[name]).project(", ".join(cols)).fetchall(), key=repr) and sorted(want.columns) == cols
