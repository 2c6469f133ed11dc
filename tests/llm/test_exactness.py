"""Hash weaknesses, brute-force versions of rules and windows, awkward positives, and the pipeline stage by stage."""

import collections
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gristmill.llm import chat, common, exact_dedup, jaccard_join, licenses, quality, suffix_dedup, token_output, tokens, warc
from test_operators import SCHEMA, awkward, brute_mix, brute_pairs, letters, prose, rows_of, words


def thue_morse(bits, letters_):
    s = "0"
    for _ in range(bits):
        s += s.translate(str.maketrans("01", "10"))
    return s.translate(str.maketrans("01", letters_))


#: Two words of 2,048 letters that every polynomial hash modulo 2^64 with an odd base takes for one.
PAIR = thue_morse(11, "ab"), thue_morse(11, "ba")


# -- hashes


def test_encoder_tells_thue_morse_words_apart():
    enc = tokens.Encoder(tokens.PATH)
    texts = [PAIR[0], PAIR[1], f"x {PAIR[0]} y", f"x {PAIR[1]} y"]
    ids, bounds = enc.encode(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in zip(bounds, bounds[1:])] == [enc.bpe.encode_ordinary(t) for t in texts]
    assert enc.counts(pa.array([*texts, None, ""])).tolist() == [len(enc.bpe.encode_ordinary(t)) for t in texts] + [0, 0]


def test_chat_tells_thue_morse_words_apart(spark):
    rows = [(1, 0, "user", PAIR[0]), (2, 0, "user", PAIR[1])]
    enc = tokens.Encoder(tokens.PATH)
    got = {r.conv_id: r.input_ids for r in chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 10_000).collect()}
    for c, _, _, text in rows:
        assert got[c] == [x for p in ("<|user|>\n", text, "<|end|>\n") for x in enc.bpe.encode_ordinary(p)]


def test_jaccard_join_tells_thue_morse_words_apart(spark):
    df = spark.createDataFrame([(1, PAIR[0]), (2, PAIR[1])], "doc_id long, text string")
    assert jaccard_join.similar_pairs(df).count() == 0 and jaccard_join.all_similar_pairs(df, 1).count() == 0
    assert jaccard_join.drop_near_duplicates(df).count() == 2


def test_suffix_dedup_tells_thue_morse_words_apart(spark):
    tail = " ".join(f"t{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{PAIR[0]} {tail}"), (2, f"{PAIR[1]} {tail}")], "doc_id long, text string")
    for doublings in (0, 1, suffix_dedup.DOUBLINGS, 5):
        assert rows_of(suffix_dedup.repeated_passages(df, 50, doublings)) == collections.Counter([(1, 1, 61), (2, 1, 61)])


def test_sets_called_the_same_are_verified_on_their_words():
    """A pair of different sets that hashes took for one comes out with its overlap, which makes the join run again."""
    rows = [(7, 0, 0, 1, None, None, "a b c"), (7, 0, 0, 2, None, None, "a b d"), (7, 0, 0, 3, None, None, "C b A"), (7, 0, 0, 1, 2, True, None), (7, 0, 0, 1, 3, False, None)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("root", "ca", "cb", "a", "b", "same", "text"), r)) for r in rows], pa.schema([("root", pa.int64()), ("ca", pa.int32()), ("cb", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("same", pa.bool_()), ("text", pa.string())]))
    out = [r for b in jaccard_join._verify(1, 0.7)(iter([batch])) for r in b.to_pylist()]
    assert out == [{"a": 1, "b": 2, "same": True, "overlap": 2, "total": 4}, {"a": 1, "b": 3, "same": False, "overlap": 3, "total": 3}]
    sets = jaccard_join._ExactSets(3)
    for i, t in enumerate(["a b", "a b c", "a b c d", "b a", "", "a  b"]):
        sets.add(i, t)
    assert sets.overlaps(0, [1, 2, 3, 4, 5]) == [0, 0, 0, 0, 1] and sets.overlaps(1, [2, 5]) == [1, 0]


def test_word_hashes_are_of_the_bytes():
    rng = random.Random(1)
    alphabet = ["a", "b", "\x00", "é", "ab" * 40, "a" * 8]
    texts = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))).replace("\x00", "\x7f") for _ in range(4000)})
    from gristmill.llm.grams import words as hashes

    for seed in (0, 1):
        h, bounds, start, end = hashes(pa.array(texts), lower=False, seed=seed)
        assert len(h) == len(texts) == len(set(h.tolist()))
        again, _, _, _ = hashes(pa.array(["x y", *texts[::-1]]), lower=False, seed=seed)
        assert again[2:].tolist() == h[::-1].tolist()


# -- 6


@pytest.mark.parametrize("size", [1, 1 << 19])
def test_a_full_and_an_empty_sieve_give_the_same_rows(spark, monkeypatch, size):
    """One plan at every size: with a bitmap of one word every row passes the sieve, with the usual one only those that must."""
    monkeypatch.setattr(common, "SIEVE_WORDS", size)
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    want = collections.Counter()
    for t, g in groups.items():
        want.update(g if t is None else [min(g, key=lambda r: (r[0] is None, r[0] or 0))])
    assert rows_of(exact_dedup.drop_exact_duplicates(docs, first=4, growth=5)) == want


# -- 3


def plain_features(t):
    raw = (t or "").encode()
    w = [x for x in re.split(rb"[\x00-\x20]+", raw) if x]
    if not w:
        return [0.0] * len(quality.FEATURES)
    ink, k = sum(map(len, w)), len(w)
    share = [sum(c in s for c in raw) / ink for s in (b"#$%&*@^~<>{}[]\\=+_", b"!", bytes(range(65, 91)), b"0123456789", b"|")]
    repeats = sum(a == b for a, b in zip(w, w[1:])) / k
    return [math.log1p(k), *share, repeats, math.log(k / len(set(w))) / math.log(k + 1), ink / k / 10, raw.count(b".") / k]


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n else 1.0


def test_features_are_the_plain_ones():
    texts = [r[1] for r in awkward()] + ["A! b|c #$ 12. b b", "é É ß", "\x1f \x7f", "a\x00b"]
    got = quality.features(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-12)


def brute_quality(rows, labels):
    """The kept rows, by plain features, an independent split, exact tails summed term by term and a walk over the cutoffs."""
    least = {}
    for i, y, _ in labels:
        if i is not None and y is not None:
            least[i] = min(y, least.get(i, 1))
    x = [plain_features(r[1]) for r in rows]
    half = {i: xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) & 1 for i in least}
    fitted = [(f, least[r[0]]) for r, f in zip(rows, x) if r[0] in least and not half[r[0]] and f[0] > 0]
    if len({y for _, y in fitted}) < 2:
        return [r for r, f in zip(rows, x) if f[0] > 0]
    model = quality.fit(np.array([f for f, _ in fitted]), np.array([y for _, y in fitted], float))
    score = quality.score(np.array(x), model)
    hold = collections.defaultdict(list)
    for r, f, s in zip(rows, x, score):
        if r[0] in least and half[r[0]] and f[0] > 0:
            hold[r[2]].append((min(int(s * quality.CUTOFFS), quality.CUTOFFS - 1), least[r[0]]))
    good_strata = {s for s, h in hold.items() if h}
    cut = {}
    for s, h in hold.items():
        n, best, gain = sum(y == 1 for _, y in h), 0, 0
        for c in range(1, quality.CUTOFFS):
            k, bad = sum(b < c and y == 1 for b, y in h), sum(b < c and y == 0 for b, y in h)
            if not n or tail(k, n, quality.ALPHA) > quality.DELTA / len(good_strata):
                break
            if bad - k > gain:
                best, gain = c, bad - k
        cut[s] = best / quality.CUTOFFS
    return [r for r, f, s in zip(rows, x, score) if f[0] > 0 and s >= cut.get(r[2], 0.0)]


def labelled_rows():
    """Awkward rows among documents of three strata, whose labels no feature separates."""
    rng, rows, labels = random.Random(8), awkward(), []
    for i in range(1500):
        bad = rng.random() < 0.4
        noise = rng.random() < 0.02
        w = prose(rng, rng.randrange(20, 90)).split()
        if bad != noise:
            w = [x + "!#" if rng.random() < 0.3 else x.upper() if rng.random() < 0.3 else x for x in w]
        rows.append((1000 + i, " ".join(w), ["en", "de", None][i % 3], "a", 1, "r", 1, 1, 1, 1, 0.1))
        labels.append((1000 + i, int(not bad), 0))
    return rows, labels + [(None, 1, 0), (1000, None, 0), (1001, 0, 1), (99999, 0, 0), (9, 1, 0), (10, 0, 0), (3, 1, 0)]


def test_quality_rules_keep_what_a_brute_force_keeps(spark):
    rows, labels = labelled_rows()
    docs, given = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = collections.Counter(brute_quality(rows, labels))
    assert 200 < len(rows) - sum(want.values()) < 800
    assert rows_of(quality.keep_quality(docs, given)) == want
    passing = quality.passing(docs, given).collect()
    assert collections.Counter((r.doc_id, r.lang) for r in passing) == collections.Counter((r[0], r[2]) for r in want.elements())


def test_tails_of_many_labels():
    for n, k, p in ((1000, 10, 0.05), (3000, 120, 0.05), (50, 49, 0.9), (7, 0, 0.5), (1, 0, 0.2)):
        assert abs(quality.binomial_cdf(k, n, p) - float(sum(math.comb(n, i) * (p**i) * ((1 - p) ** (n - i)) for i in range(k + 1)) if n < 1000 else exact_tail(k, n, p))) < 1e-10
    # 10 million labels take no sum over them
    assert 0.49 < quality.binomial_cdf(500_000, 10_000_000, 0.05) < 0.51 and quality.binomial_cdf(400_000, 10_000_000, 0.05) < 1e-300


def exact_tail(k, n, p):
    from fractions import Fraction

    q = Fraction(p).limit_denominator(1000)
    return sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))


# -- 2


def brute_windows(sizes, system, budget, history_turns, history_tokens):
    out, at = [], 0
    while at < len(sizes):
        head = sizes[0] if system and at and sizes[0] <= budget else 0
        past, spent, low = at, 0, 1 if system else 0
        while past > low and at - past < history_turns and spent + sizes[past - 1] <= min(history_tokens, budget - head - sizes[at]):
            past, spent = past - 1, spent + sizes[past - 1]
        end = at + 1
        over = head + spent + sizes[at] > budget
        while not over and end < len(sizes) and head + sum(sizes[past : end + 1]) <= budget:
            end += 1
        if over:
            past, head = at, 0
        out.append((at, end, past, bool(system and (at == 0 or head)), over))
        at = end
    return out


def test_windows_are_the_greedy_ones():
    """As few windows as whole turns allow, as much history as fits: against turn-by-turn loops."""
    rng = random.Random(5)
    for _ in range(3000):
        sizes = [rng.choice([1, 3, 10, 40, 90, 200]) for _ in range(rng.randrange(1, 25))]
        args = rng.random() < 0.5, rng.choice([20, 100, 150]), rng.randrange(4), rng.choice([0, 5, 50, 500])
        got = chat.windows(sizes, *args)
        assert got == brute_windows(sizes, *args)
        for at, _, past, _, _ in got:
            assert sum(sizes[past:at]) <= args[3] and at - past <= args[2]


def test_null_roles_ties_and_long_turns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, 0, None, "same"), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, 1, "assistant", "yes"), (2, 0, "user", long), (2, 1, "assistant", "short")]
    got = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "window").collect()
    enc = tokens.Encoder(tokens.PATH)
    assert [(r.conv_id, r.first_turn, r.last_turn, r.over_budget) for r in got] == [(1, 0, 2, False), (2, 0, 0, True), (2, 1, 1, False)]
    assert enc.bpe.decode(got[0].input_ids) == "<|user|>\nsame<|end|>\n" * 2 + "<|assistant|>\nyes<|end|>\n"
    assert enc.bpe.decode(got[1].input_ids) == f"<|user|>\n{long}<|end|>\n"


# -- 4


def test_license_positives_in_awkward_rows(spark):
    filler = "nothing of the kind. " * 30_000
    rows = [(1, "MIT License"), (1, "MIT License"), (None, "the  MIT\tLicense"), (2, filler + "BSD-style license" + filler), (3, "MIT\x0bLicense\x1cGPLv3"), (4, "Licensed under the MIT license or the Apache License, Version 2.0")]
    got = collections.Counter((r.doc_id, r.license, r.matched) for r in licenses.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter(
        [(1, "MIT", "MIT License")] * 2 + [(None, "MIT", "the  MIT\tLicense"), (2, "BSD-3-Clause", "BSD-style license"), (3, "MIT", "MIT\x0bLicense"), (3, "GPL-3.0-only", "GPLv3"), (4, "MIT", "Licensed under the MIT license"), (4, "Apache-2.0", "Apache License, Version 2.0")]
    )


def test_hidden_branches_are_found():
    s = licenses.scanner()
    cases = {"Apache Software License, Version 2.0": "Apache-2.0", "zlib/libpng license": "Zlib", "PSF License": "Python-2.0", "BSD-style license": "BSD-3-Clause", "OpenSSL/SSLeay license": "OpenSSL", "FreeType License": "FTL", "Open RAIL license": "OpenRAIL", "MIT/X11 License": "MIT"}
    assert {t: [r[0] for r in s.scan(t)] for t in cases} == {t: [v] for t, v in cases.items()}
    assert [r[0] for r in s.scan("SPDX-License-Identifier: mit OR apache-2.0.")] == ["MIT OR Apache-2.0"]


def test_overlaps_are_resolved_as_one_by_one():
    """The sweep against the comparison of each detection with all kept ones; equal intervals, nested and crossing ones."""
    table = [(f"r{i}", f"L{i}", p, (k,), x) for i, (p, k, x) in enumerate([(60, "a", "a+"), (60, "a", "a+b"), (90, "b", "b"), (60, "a", "a+"), (20, "a", "[ab]+c?"), (70, "b", "ab+")])]
    s, rng = licenses.Scanner(table), random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("aaabc ") for _ in range(rng.randrange(1, 30)))
        hits = sorted((-p, m.start() - m.end(), i, *m.span()) for i, (_, _, p, _, x) in enumerate(s.rules) for m in x.finditer(text))
        kept = []
        for _, _, i, a, z in hits:
            if not any(b <= a and z <= y for b, y, _ in kept):
                kept.append((a, z, f"r{i}"))
        flat = re.sub(r"\s+", " ", text)
        if flat == text:
            assert sorted(kept) == sorted((a, z, r) for _, r, _, a, z in s.scan(text)), text


# -- 10


@pytest.mark.parametrize("head,error", [(b"Content-Length: x\r\n", ValueError), (b"", ValueError), (b"Content-Length: 99\r\n", EOFError)])
def test_warc_bad_records_raise(head, error):
    raw = zlib.compress(b"WARC/1.0\r\n" + head + b"\r\nbody\r\n\r\n", wbits=31)
    with pytest.raises(error):
        for _, _, payload in warc.records(io.BytesIO(raw)):
            list(payload())


def test_warc_header_without_end_raises():
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(zlib.compress(b"x" * (3 * warc.HEAD), wbits=31))))


# -- the pipeline


def brute_near(rows, n, t):
    """Least of each connected group, over (number, text)."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute_pairs(rows, n, t):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i for i in root if find(i) == i}


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows against a brute-force version of it on what its predecessor kept; awkward rows, copies, near copies and labels."""
    import corpus_pipeline

    rows, labels = labelled_rows()
    rng = random.Random(9)
    for i in range(60):
        t = rows[100 + i][1]
        near = " ".join(x if rng.random() > 0.04 else "changed" for x in t.split())
        rows += [(5000 + i, t, "en", "b", 1, "r", 1, 1, 1, 1, 0.1), (6000 + i, near, "de", None, 1, "r", 1, 1, 1, 1, 0.1)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), rows
    enc = tokens.Encoder(tokens.PATH)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, folder)
        df.write.parquet(str(tmp_path / f"out{k}"))
        before, docs = kept, spark.read.schema(df.schema).parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert df.columns == spark.createDataFrame([], SCHEMA).columns
            kept = [tuple(r) for r in docs.collect()]
        # ties among rows of one id go by the other columns' JSON: the numbers are the operators' own
        order = {r.rid: tuple(r.row) for r in common.with_row_id(spark.createDataFrame(before, SCHEMA))[0].collect()} if k in (1, 2, 3) else {}
        if name == "quality rules":
            want = collections.Counter(brute_quality(before, labels))
        elif name == "exact dedup":
            first = {}
            for i in sorted(order):
                first.setdefault(order[i][1], order[i])
            want = collections.Counter(first.values())
        elif name == "near dedup":
            want = collections.Counter(order[i] for i in brute_near([(i, r[1]) for i, r in order.items()], jaccard_join.N, jaccard_join.THRESHOLD))
            assert len(before) - sum(want.values()) > 30
        elif name == "source mixing":
            drawn = brute_mix([(i, r[1], r[3]) for i, r in order.items()], None, 100, lambda t: len(enc.bpe.encode_ordinary(t)), letters)
            want = collections.Counter()
            for i, c in drawn.items():
                want[order[i]] += c
        else:
            used = collections.Counter()
            for r in docs.collect():
                used[r.doc_id] += r.n_tokens
            want = collections.Counter()
            for r in before:
                want[r[0]] += len(enc.bpe.encode_ordinary(r[1]))
            assert used == want
            continue
        assert collections.Counter(kept) == want, name
    result = rows_of(corpus_pipeline.run(spark, folder))
    assert result == rows_of(docs) and len(result) > 500


def test_pipeline_on_empty_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# -- 1


def test_row_groups_stay_near_their_bound(spark, tmp_path):
    """The writer looks at the size every hundred rows at least: groups end within half of the bound beyond it."""
    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bound = 128 << 10
    token_output.write_tokens(token_output.tokenized(docs).coalesce(1), str(tmp_path / "t"), row_group=bound, page=8 << 10, page_rows=50)
    (file,) = (tmp_path / "t").glob("*.parquet")
    m = pq.ParquetFile(file).metadata
    sizes = [sum(m.row_group(g).column(c).total_compressed_size for c in range(m.num_columns)) for g in range(m.num_row_groups)]
    assert len(sizes) > 5 and max(sizes) <= bound * 1.5 and sum(m.row_group(g).num_rows for g in range(m.num_row_groups)) == docs.count()
