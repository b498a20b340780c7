"""Merkle manifest, centroid clustering and token counts against brute force and on odd rows; helper columns that clash."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from starloom.llm import centroids, decontaminate, line_dedup, merkle, near_dedup, token_counts
from starloom.llm.common import fresh

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# Merkle manifest
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity=2):
    """What the contract says, row by row: (doc_id, leaf, subroot, root, proof, folded, verified)."""
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha(*[cell(r[c] + more if c == "n_chars" and r[c] is not None else r[c]) for c in merkle.COLUMNS])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        return levels

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = []
            for levels, j in ((trees[g], i), (top, at)):
                for nodes in levels[:-1]:
                    run = nodes[j // arity * arity : j // arity * arity + arity]
                    path.append((run[: j % arity], run[j % arity + 1 :]))
                    j //= arity
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = leaf(r, 1 if tampered else 0)
            for left, right in path:
                folded = sha(*left, folded, *right)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], sha(*[x for pair in path for side in pair for x in side]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "arity"), [(0, 2), (1, 2), (2, 2), (37, 2), (300, 2), (300, 3)])
def test_manifest(spark, n, arity):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "a"]), rng.choice([None, "", "en", "é"]), rng.choice([None, 3]), rng.choice([None, "", "x", "long " * 5000])) for _ in range(n)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    hit = merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(df, tampered=hit, changed={"n_chars": merkle.F.col("n_chars") + 1}, arity=arity, rows=16)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == (brute_manifest([r.asDict() for r in df.collect()], arity) if n else [])


def test_manifest_of_a_table_with_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(i, "s", "en", 1, "t", i, "x", "y") for i in range(9)], DOCS + ", part long, leaf string, root string")
    got = merkle.manifest(df, with_path=True)
    assert got.columns[-3:] == ["lang", "position", "path"] and len({r["root"] for r in got.collect()}) == 1
    for r in got.collect():
        assert merkle.fold(r["leaf"].encode(), [(p["left"].encode(), p["right"].encode()) for p in r["path"]]).decode() == r["root"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(2, 4), st.randoms())
def test_fragments_merge_in_any_order(size, arity, rng):
    """However the leaves are cut and the fragments are grouped, the same single root is left."""
    leaves = np.array([sha(str(i)).encode() for i in range(size)], "S64")
    cuts = sorted({0, size, *(rng.randrange(size + 1) for _ in range(5))})
    parts = [(merkle.fragment("g", merkle.climb(leaves[a:b], a, size, arity), arity), {}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rng.shuffle(parts)
    while len(parts) > 1:
        at = rng.randrange(len(parts) - 1)
        parts[at : at + 2] = [merkle.merge(parts[at], parts[at + 1], {"g": size}, arity)]
    whole = merkle.climb(leaves, 0, size, arity)
    assert parts[0][0] == {("g", len(whole) - 1, 0): whole[-1][1][0]}


# centroid clustering
def brute_clusters(rows, k=8, rounds=10):
    rows = [(i, [np.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not rows:
        return []
    x = np.array([v for _, v in rows]).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), x[i].tolist()))
    centres = x[order[:k]]
    nearest = lambda: np.array([((x - c) ** 2).sum(axis=1) for c in centres]).T
    for _ in range(rounds):
        own = nearest().argmin(axis=1)
        centres = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c for j, c in enumerate(centres)])
    far = nearest()
    own, far = far.argmin(axis=1), far.min(axis=1)
    return sorted([(i, int(c), int(d), int(far[own == c].sum()), int(far.sum()), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for (i, _), c, d in zip(rows, own, far, strict=True)], key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int").repartition(3)


def test_clusters(spark):
    """Groups that overlap, repeated rows and ids, ties on a grid, and vectors that do not count."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(9, 64))
    rows = [(i, (middles[i % 9] + rng.normal(size=64) * 0.4).tolist()) for i in range(500)]
    rows += [(1000 + i, [float(x) / 64 for x in rng.integers(-1, 2, 64)]) for i in range(60)] + [(i, rows[i][1]) for i in range(20)] + [(5, [0.5] * 64)]
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [None] + [1.0] * 63), (2003, [float("nan")] + [1.0] * 63), (2004, [float("inf")] + [1.0] * 63), (2005, [])]
    df = vectors(spark, rows)
    got = centroids.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()])


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, n):
    df = vectors(spark, [(i // 2, [float(i)] * 64) for i in range(n)])
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=repr) == brute_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_huge_components_are_held(spark):
    got = centroids.cluster(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (None, [0.0] * 64)]), k=2).collect()
    assert len(got) == 3 and all(0 <= r["distance"] <= r["cluster_inertia"] <= r["inertia"] for r in got)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 6), st.integers(2, 12))
def test_bounds_never_change_an_assignment(seed, k, spread):
    """Several rounds with bounds equal rounds without, on small grids full of ties, and compute fewer distances."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (200, 3)).astype(np.int32)
    centres = x[rng.choice(200, k, replace=False)].astype(np.int64)
    own, upper, lower = np.zeros(200, np.int32), np.full(200, np.inf), np.zeros((200, k))
    step, computed = centroids.Step.of(centres), 0
    for _ in range(8):
        computed += centroids.assign(x, own, upper, lower, step)
        far = np.array([((x.astype(np.int64) - c) ** 2).sum(axis=1) for c in step.centroids]).T
        assert (own == far.argmin(axis=1)).all()
        assert (upper**2 >= far.min(axis=1)).all() and (lower**2 <= far).all()
        moved = np.array([x[own == j].astype(np.int64).sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else c for j, c in enumerate(step.centroids)])
        step = centroids.Step.of(moved, step.centroids)
    assert computed <= 8 * 200 * k


# token counts
ALPHABET = [*"aab  \n\t.'|<>1290é 　中文。，\x1c\x85s't=+/-_", "<|endoftext|>", "  ", "'ll", "\r\n"]


@pytest.mark.parametrize("long", [token_counts.LONG, 3])
def test_cuts_are_safe(monkeypatch, long):
    """The sum over units is the length of the whole, with and without cuts inside long units."""
    monkeypatch.setattr(token_counts, "LONG", long)
    rng, lengths = random.Random(5), token_counts.Lengths(token_counts.TOKENIZER)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(60))).encode() for _ in range(4000)]
    assert lengths.cuttable and lengths.of(texts).tolist() == lengths.encoded(texts)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    assert lengths.of(texts[:100]).tolist() == lengths.encoded(texts[:100])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    rng = random.Random(6)
    texts = [None, "", " ", "<|endoftext|>", "a <|startoftext|> b", "Ab1" * 30000, "中文。" * 3000, "word " * 600] + ["".join(rng.choices(ALPHABET, k=rng.randrange(300))) for _ in range(60)]
    df = spark.createDataFrame([(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts + texts[:5])], "doc_id long, text string, n_tokens string, text_ int").repartition(3)
    got = token_counts.count_tokens(df, tokenizer=path(name))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    if name.endswith(".json"):
        tokenizer = Tokenizer.from_file(path(name))
        size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    else:
        model = sentencepiece.SentencePieceProcessor(model_file=path(name))
        size = lambda t: len(model.encode(t))
    want = [(r["doc_id"], len((r["text"] or "").encode()), size(r["text"] or ""), size(r["text"] or "") > 512) for r in df.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(df.limit(0)).collect() == []


# columns of the input with the names of helper columns
CLASH = "doc_id long, text string, __r1 long, __r2 string, __keys long, __k1 string, __id long, __key long"


def test_clashing_columns(spark):
    rows = [(i, f"same line\nown {i} words here for all to see and one more {i % 7}", i, "x", i, "a", i, i) for i in range(30)] + [(99, None, 1, None, 1, None, 1, 1), (100, "", 1, None, 1, None, 1, 1)]
    df = spark.createDataFrame(rows, CLASH)
    assert fresh(df, "__k1", "__K1", "new") == ["__k1_", "__K1__", "new"]
    same = lambda a, b: a.columns == b.columns and sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    small, large = line_dedup.line_dedup(df), line_dedup.line_dedup(df, broadcast_keys=0)
    assert same(small, large) and small.columns == [*df.columns, "kept_text", "n_lines", "n_dropped"]
    benchmark = spark.createDataFrame([(f"i{k}", f"own {k} words here for all to see and") for k in range(10)], "item_id string, text string")
    small, large = decontaminate.find_windows(df, benchmark), decontaminate.find_windows(df, benchmark, max_bytes=30)
    assert same(small, large) and small.columns[: len(df.columns)] == df.columns
    assert sorted(map(tuple, near_dedup.drop_near_duplicates(df.union(df)).collect()), key=repr) == sorted(rows, key=repr)
