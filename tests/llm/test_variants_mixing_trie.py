"""Spelling variants, mixing and the conversation trie against plain brute force, with the cases that tables may hold."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from skein.llm import mixing, prefix_trie, queries, variants
from skein.llm.shared import materialize

SF = "/root/testdata/sf0.001"


def one_edit(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
    return out - {word}


def brute_variants(rows, min_chars=5, min_count=3, factor=2, spoilt=97):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if spoilt and h % spoilt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_chars and c >= min_count}
    letters = sorted({c for w in n for c in w})
    forms, near = {}, {}
    for w in n:
        near[w] = [x for x in one_edit(w, letters) if x in n]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        last = w
        while forms[last]:
            last = forms[last]
        out[w] = (forms[w], last, n[w], len(near[w]), n[forms[w]] if forms[w] else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("piece", [30, 25_000])
def test_variants(spark, piece, monkeypatch):
    monkeypatch.setattr(variants, "PIECE", piece)
    r = random.Random(piece)
    base = ["".join(r.choice("abÿé") for _ in range(r.randint(5, 9))) for _ in range(250)]
    rows = []
    for i in range(60):
        words = [w.upper() if r.random() < 0.2 else w for w in r.choices(base, weights=[1 + 200 // (k + 1) for k in range(len(base))], k=90)]
        rows.append((i, r.choice([" ", ", ", "\n", "1"]).join(words), "x", 3))
    long = "ab" * 2000
    rows += [(100 + k, " ".join([long, long[:1500] + "c" + long[1500:], long[:-1] + "z"]), "x", 3) for k in range(5)]
    rows += [(200, None, "x", 3), (201, "", "x", 3), (202, "1 2 中文 ×÷×÷×", "x", 3), (None, base[0], "x", 3), rows[0], rows[0]]
    rows.append((203, " ".join(["qwert"] * 9 + ["qwertz"] * 20 + ["qwertzu"] * 50), "x", 3))
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    got = variants.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants([x[:2] for x in rows if len(x[1] or "") < 5000])
    # the long words are too long for the brute force, which tries all letters at all places
    got = result(got)
    assert {w: v for w, v in got.items() if len(w) < 1000} == want
    assert [got[w][3] for w in (long, long[:1500] + "c" + long[1500:], long[:-1] + "z")] == [2, 1, 1]
    assert any(v[1] not in (w, v[0]) for w, v in want.items())  # a chain of two forms
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_variants_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op11_spelling_variants(spark, SF)) == brute_variants(rows)


def test_wavelet_tree():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 2, 3, 37, 200):
        values = r.permutation(n)
        tree = variants.WaveletTree(values)
        lo, low = r.integers(0, n + 1, 60), r.integers(0, n + 1, 60)
        hi, high = np.minimum(n, lo + r.integers(0, n + 1, 60)), np.minimum(n, low + r.integers(0, n + 1, 60))
        got = sorted(zip(*(x.tolist() for x in tree.report(lo, hi, low, high)), strict=True))
        assert got == sorted((q, int(v)) for q in range(60) for v in values[lo[q] : hi[q]] if low[q] <= v < high[q])


def brute_targets(sizes, weights, epochs, total):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {s: 0.0 for s in names}, set(names)
    while free:
        level = (total - sum(epochs * sizes[s] for s in names if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > epochs * sizes[s]}
        target |= {s: level * weight[s] for s in free - over} | {s: float(epochs * sizes[s]) for s in over}
        if not over:
            break
        free -= over
    return target


def check_mix(rows, got, weights=(1, 2, 3), epochs=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, ties = Counter(), Counter(), Counter()
    for _, text, source, *_ in rows:
        sizes[source] += size(text)
    ties.update((i, t) for i, t, *_ in rows)
    target = brute_targets(sizes, weights, epochs, sum(sizes.values()))
    assert len(got) == len(rows)
    source = {(i, size(t)): s for i, t, s, *_ in rows}
    for x in got:
        s = source[x["doc_id"], x["size"]]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(target[s], rel=1e-12)
        assert 0 <= x["copies"] * x["size"] <= x["taken"] <= epochs * x["size"]
        taken[s] += x["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + max(ties.values()) - 1, s
    return taken


def test_mixing(spark):
    r = random.Random(5)
    words = lambda n: " ".join(r.choice(["a", "bé", "中"]) for _ in range(n))
    rows = [(i, words(r.choice([0, 1, 3, 20, 300])), r.choice(["b", "a", "é", "Z", "\U0001f600", "￮", None, "rare"] if r.random() < 0.02 else ["a", "a", "b", "Z", "é"]), 1) for i in range(400)]
    rows += [(900, None, "empty", 1), (901, "", "empty", 1), (902, " \n\x0b", None, 1), (903, " x", None, 1), (None, "q w e", "a", 1), (None, "q w e", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(df.repartition(3))
    assert got.columns == ["doc_id", "size", "source_size", "target", "copies", "taken"]
    first = sorted(map(str, got.collect()))
    check_mix(rows, got.collect())
    assert first == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert {x["taken"] for x in mixing.mix_sources(df.where("source = 'empty'")).collect()} == {0}
    one = mixing.mix_sources(df.where("source = 'a'")).collect()
    assert all(x["taken"] == x["size"] for x in one)


def test_mixing_of_many_sources_and_ties(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL_ROWS", 5)
    rows = [(i, "w " * (1 + i % 7), f"s{i}", 1) for i in range(60)] + [(107, "x y z", "hot", 1)] * 50 + [(108, "one two", "hot", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = mixing.mix_sources(df).collect()
    check_mix(rows, got)
    assert len({x["taken"] for x in got if x["doc_id"] == 107}) == 1  # rows that tie are treated alike


def test_water_filling_clamps_in_rounds(spark):
    rows = [(i, "w " * n, s, 1) for i, (s, n) in enumerate([("a", 1), ("b", 4), ("c", 30), ("d", 200), ("e", 4000)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    taken = check_mix(rows, mixing.mix_sources(df).collect())
    assert [taken[s] for s in "abcd"] == [3, 12, 90, 600]


def brute_trie(rows, follow=True):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conv[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    new = dict(own)
    if follow:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 6
            new[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids.update(k[:-1] for k in members if k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k: ",".join(str(c) for c in sorted(members[k]) if len(new[c]) == len(k))
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items()), key=str)


def rebuilt(df):
    conv = F.col("conv_id")
    rows = materialize(prefix_trie.turn_rows(df), "turns")
    return prefix_trie.trie(prefix_trie.regrafted(rows, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5))


@pytest.mark.parametrize("packed", [3, 4096])
def test_trie(spark, packed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACKED", packed)
    r = random.Random(8)
    rows = []
    for c in range(240):
        if c % 100 or c == 100:
            for t in range(r.choice([1, 2, 4, 9])):
                rows.append((c, r.choice([t, t, None]), r.choice(["user", "bot", None]), r.choice(["", None, "é中", "a", "hello"]), 5))
    rows += [(500, t, "user", "same", 5) for t in range(60)] + [(501, t, "user", "same", 5) for t in range(50)]
    rows += [(None, 1, "user", "x", 5), rows[0], rows[0]] + [(1000 + c, 0, "system", "hot", 5) for c in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int").repartition(3)
    plain = prefix_trie.prefix_trie(df)
    assert plain.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, plain.collect()), key=str) == brute_trie([x[:4] for x in rows], follow=False)
    assert sorted(map(tuple, rebuilt(df).collect()), key=str) == brute_trie([x[:4] for x in rows])
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0 and rebuilt(df.limit(0)).count() == 0


def test_trie_of_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, queries.op13_conversation_trie(spark, SF).collect()), key=str) == brute_trie([tuple(x) for x in rows])
