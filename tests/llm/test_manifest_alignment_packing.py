"""Operators 11 to 13 against plain versions, and their values on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import alignment, merkle, packing, queries, tokens

from .test_operators import ODD

LONG = [*ODD, (7, "<|endoftext|> x <|endoftext|>"), (8, "a ▁ b"), (9, "naïve 中文 🙂\r\n\ttabs  and   runs "), (10, "\x00\x1c"), (11, "word " * 9_000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, s, "clash", 1.0) for r, s in zip(LONG, ["a", None, "b", "a", None, "b", "b", "é", "z", "a", "", "a", "b"])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, root string, n_a double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return {"a": public_tokenizers.path(queries.BYTE_LEVEL), "b": public_tokenizers.path(queries.PIECES), "pattern": public_tokenizers.PATTERN}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def climb(nodes, fan):
    """All levels of one tree, from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + fan])) for i in range(0, len(now), fan)])
    return levels


def proof(levels, at, fan):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at - at % fan : at - at % fan + fan]
        out.append((at % fan, run[: at % fan] + run[at % fan + 1 :]))
        at //= fan
    return out


def plain_manifest(rows, fan):
    """(leaf, subroot, root, proof) of (source, id, leaf) rows, as a list in any order."""
    groups = defaultdict(list)
    for source, i, leaf in rows:
        groups[source].append((i is not None, i or 0, leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([leaf for *_, leaf in sorted(groups[s])], fan) for s in order]
    over = climb([t[-1][0] for t in trees], fan)
    return [(leaf, t[-1][0], over[-1][0], proof(t, k, fan) + proof(over, g, fan)) for g, t in enumerate(trees) for k, leaf in enumerate(t[0])]


def folded(leaf, steps):
    for slot, others in steps:
        leaf = sha("".join([*others[:slot], leaf, *others[slot:]]))
    return leaf


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_manifest_equals_plain_trees(spark, fan):
    rng = random.Random(fan)
    rows = [(rng.choice([None, "a", "a", "a", "b", "é", "Z"]), rng.choice([None, *range(40)]), rng.choice(["x", "y"])) for _ in range(300)] + [("one", 1, "x")]
    leaves = spark.createDataFrame(rows, "source string, doc_id long, text string").withColumn("digest", merkle.row_digest([F.col("source"), F.col("doc_id"), F.col("text")])).drop("text")
    found = merkle.manifest(leaves, fan_out=fan)
    assert found.columns == [*leaves.columns, "path", "subroot", "root"]
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = plain_manifest([(s, i, sha(said(s) + said(i) + said(t))) for s, i, t in rows], fan)
    got = [(r.digest.hex(), r.subroot.hex(), r.root.hex(), [(p.slot, [p.siblings[i : i + 32].hex() for i in range(0, len(p.siblings), 32)]) for p in r.path]) for r in found.collect()]
    assert sorted(got) == sorted(want) and all(folded(leaf, steps) == root for leaf, _, root, steps in got)
    again = found.select((merkle.fold(F.col("digest"), F.col("path")) == F.col("root")).alias("ok"), (merkle.fold(F.unhex(F.sha2(F.lit("forged").cast("binary"), 256)), F.col("path")) == F.col("root")).alias("forged"))
    assert {tuple(r) for r in again.collect()} == {(True, False)}


def test_manifest_query_finds_tampering(spark, sf_dir, docs):
    found = {r.doc_id: r for r in queries.op11_merkle_manifest(spark, sf_dir).collect()}
    for r in docs.collect():
        f = found[r.doc_id]
        lower = r.text.translate({c: c + 32 for c in range(65, 91)})
        assert f.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0 or lower == r.text) == (f.folded_root == f.root)


def test_manifest_on_awkward_rows(odd, empty, spark, tmp_path):
    leaves = odd.select("doc_id", "source", "root", merkle.row_digest([F.col("doc_id"), F.col("text")]).alias("digest")).withColumn("g", F.lit(1))
    found = merkle.manifest(leaves.withColumnRenamed("root", "n"))
    assert found.count() == len(LONG) and {bool(r.ok) for r in found.select((merkle.fold(F.col("digest"), F.col("path")) == F.col("root")).alias("ok")).collect()} == {True}
    one = merkle.manifest(leaves.where("doc_id = 1").select("doc_id", "source", "digest")).collect()
    assert [(r.digest, r.path) for r in one] == [(one[0].root, [])]
    assert merkle.manifest(empty.select("doc_id", "source", F.lit(b"x").alias("digest"))).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for n in ("op11_merkle_manifest", "op12_cross_tokenizer_alignment", "op13_best_fit_packing"):
        assert queries.QUERIES[n](spark, str(tmp_path)).count() == 0


def noise(n, seed):
    rng = random.Random(seed)
    letters = ["a", "B", "é", "ß", "中", "🙂", " ", "  ", "\n", "\t", "'s", "1", "２", ".", "!!", "▁", "<0x41>", "<s>", "<|endoftext|>", "\x00", " ", " ", "\x1c", "of the ", "ing"]
    return ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(n)]


def test_byte_level_ids_are_those_of_the_tokenizers_library(docs, files):
    from tokenizers import Tokenizer

    coder = tokens.byte_encoder(tokens.ByteLevel.load(files["a"], files["pattern"]))
    texts = [r.text for r in docs.collect()] + noise(3_000, 1) + [t or "" for _, t in LONG]
    for specials in (True, False):
        theirs = Tokenizer.from_file(files["a"])
        theirs.encode_special_tokens = not specials
        want = theirs.encode_batch(texts, add_special_tokens=False)
        assert all(tokens.encode(coder, t, specials).tolist() == w.ids for t, w in zip(texts, want))


def plain_alignment(rows, files):
    """What op12 says of (doc_id, text) rows, by loops over all pairs of tokens in a group."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder, b_coder = Tokenizer.from_file(files["a"]), sentencepiece.SentencePieceProcessor(model_file=files["b"])
    a_coder.encode_special_tokens = True
    byte = tokens._byte_of()
    measured, counts = [], Counter()
    for i, text in rows:
        done = None
        if text:
            a, b = a_coder.encode(f" {text}", add_special_tokens=False).ids, b_coder.encode(text)
            x = [bytes(byte[c] for c in a_coder.id_to_token(t)) for t in a]
            y = [bytes([int(p[3:5], 16)]) if b_coder.is_byte(t) else p.replace("▁", " ").encode() for t in b for p in [b_coder.id_to_piece(t)]]
            if b"".join(x) == b"".join(y) == f" {text}".encode():
                ends = lambda z: np.cumsum([len(t) for t in z]).tolist()
                ex, ey = ends(x), ends(y)
                common, links, said, p, q = set(ex) & set(ey), [], [], 0, 0
                for e in sorted(common):
                    ga, gb = [k for k in range(p, len(a)) if ex[k] <= e], [k for k in range(q, len(b)) if ey[k] <= e]
                    links += [(a[k], b[j]) for k in ga for j in gb if max(ex[k] - len(x[k]), ey[j] - len(y[j])) < min(ex[k], ey[j])]
                    said.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[j]) for j in gb))
                    p, q = ga[-1] + 1, gb[-1] + 1
                counts.update(links)
                done = (len(a), len(b), len(said), links, sha(";".join(said)))
        measured.append((i, done))
    most = Counter()
    for (_, b), c in counts.items():
        most[b] = max(most[b], c)
    out = []
    for i, done in measured:
        if done is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, text = done
            out.append((i, n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), text))
    return sorted(out, key=str)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most_sent", [alignment.MOST_SENT, 50, 0])
def test_alignment_equals_plain_loops(spark, docs, files, most_sent):
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 1500").collect()] + [r for r in LONG if len(r[1] or "") < 100] + list(enumerate(noise(150, 2), 1_000))
    used = alignment.Tokenizers.load(files["a"], files["pattern"], files["b"])
    found = alignment.measures(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_a string"), used, most_sent=most_sent)
    assert found.columns == NAMES
    want = plain_alignment(rows, files)
    assert sum(w[1] == 0 for w in want) >= 4  # null, empty, and texts that B does not give back
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_alignment_of_hot_and_long_texts(spark, files, monkeypatch, odd):
    used = alignment.Tokenizers.load(files["a"], files["pattern"], files["b"])
    rows = [(i, "the same words again") for i in range(60)] + [(i, f"text {i} alone") for i in range(60, 90)] + [(1, None)] * 30
    plain = plain_alignment(rows, files)
    for share in (1_000, 10, 1):  # all texts by broadcast, only the hot one, none
        monkeypatch.setattr(alignment, "HOT_SHARE", share)
        found = alignment.measures(spark.createDataFrame(rows, "doc_id long, text string"), used)
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain
    assert {r.doc_id: r.n_a > 0 for r in alignment.measures(odd, used).collect()} == {i: bool(t) and i != 8 for i, t in LONG}


def test_greedy_then_two_for_the_smallest():
    counts = np.zeros(11, np.int64)
    for n in (7, 2, 3, 6, 4):
        counts[n] += 1
    assert packing.plan(counts, 10) == [([7, 3], 1), ([6, 4], 1), ([2], 1)]
    counts = np.zeros(21, np.int64)
    counts[[9, 8, 6, 5]] = [1, 1, 1, 1]  # greedy: 9 and 8, gap 3; 6 and 5 fit the 11 that are left without the 8
    assert packing.plan(counts, 20) == [([9, 6, 5], 1), ([8], 1)]


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_and_few_bins(seed):
    rng = np.random.default_rng(seed)
    length = [50, 300, 2048][seed % 3]
    counts = np.bincount(np.minimum(rng.gamma(0.7, length / 4, 20_000).astype(int) + 1, length), minlength=length + 1)
    bins = packing.plan(counts, length)
    held = np.zeros(length + 1, np.int64)
    for kinds, times in bins:
        assert sum(kinds) <= length and times > 0
        np.add.at(held, kinds, times)
    assert (held == counts).all()
    whole = counts * np.arange(length + 1)
    least = max(-(-int(whole.sum()) // length), int(counts[length // 2 + 1 :].sum()))
    assert sum(t for _, t in bins) <= least * 1.002 + 1


def check_packing(rows, packed, ids_of, length):
    """Every piece once, of the right ids, and sequences without gaps or overlaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want, got = Counter(), Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    for i, text in rows:
        ids = [*ids_of(text or ""), 0]
        first = len(ids) % length or length
        at = [0, *range(first, len(ids) + 1, length)]
        for k, (p, q) in enumerate(zip(at, at[1:])):
            want[i, k, p, q - p, zlib.crc32(np.array(ids[p:q], "<u4").tobytes())] += 1
    assert got == want
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.concatenate([[0], np.cumsum([n for _, n in places])])[:-1].tolist() and sum(n for _, n in places) <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_packing_of_whole_tables(spark, sf_dir, docs, files, odd):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(files["a"])
    ids_of = lambda t: theirs.encode(t, add_special_tokens=False).ids
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    packed = queries.op13_best_fit_packing(spark, sf_dir).collect()
    n = check_packing(rows, packed, ids_of, 2048)
    big = sum(r.length > 1024 for r in packed)
    assert n <= max(-(-sum(r.length for r in packed) // 2048), big) + 1
    vocabulary = tokens.ByteLevel.load(files["a"], files["pattern"])
    found = packing.pack(odd, vocabulary, length=64)
    check_packing(LONG, found.collect(), ids_of, 64)
    held = {r.sequence_id: r for r in packing.sequences(found).collect()}
    for r in found.collect():
        assert held[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids and r.doc_id in held[r.sequence_id].doc_ids
    with pytest.raises(ValueError):
        packing.pack(odd, vocabulary, length=packing.MAX_LENGTH + 1)
