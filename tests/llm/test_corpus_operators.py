"""Line dedup and the Jaccard join against brute force, the two classifiers on held-out rows, and the pipeline."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from skein.llm import graph, jaccard, langid, line_dedup, quality_model, shared

SF = "/root/testdata/sf0.001"


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, x) for x in range(1001, 1100)] + [(x, x + 1) for x in range(2000, 2040)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [(a, b) for a, b in links if a != b]
    find = roots({x for e in links for x in e}, links)
    least = {}
    for n, k in find.items():
        least[k] = min(least.get(k, n), n)
    assert got == {n: least[k] for n, k in find.items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_line_dedup(spark, threshold):
    r = random.Random(threshold)
    base = ["".join(r.choice("abcdé fghißjk") for _ in range(r.randint(18, 50))).strip() or "x" for _ in range(20)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(r.randint(1, 4)):
            s = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                k = r.randrange(len(s))
                s[k : k + r.randint(0, 1)] = r.choice(["", "z", "é"])
            lines += ["".join(s), *([""] if r.random() < 0.2 else [])]
        rows.append((i, "\n".join(lines), "k", 7))
    rows += [(90, None, "k", 7), (91, "", "k", 7), (92, " \n\t", "k", 7), (None, base[0], "k", 7), (3, rows[3][1], "k", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, h int").repartition(3)
    first = {}
    for i, t, *_ in rows:
        if i is not None and t:
            for k, x in enumerate(t.split("\n")):
                if x.strip():
                    first[x] = min(first.get(x, (i, k)), (i, k))
    least = 24
    long = [x for x in first if len(x) >= least]
    find = roots(long, [(a, b) for n, a in enumerate(long) for b in long[:n] if abs(len(a) - len(b)) <= threshold and edit(a, b) <= threshold])
    best = {}
    for x in long:
        best[find[x]] = min(best.get(find[x], first[x]), first[x])
    keep = {best[find[x]] if len(x) >= least else first[x] for x in first}
    got = line_dedup.dedup_lines(df, threshold=threshold, min_chars=least)
    assert got.columns == [*df.columns, "_lines", "_removed"] and got.count() == len(rows)
    for x in got.collect():
        if x["doc_id"] is None:
            assert x["text"] == base[0]
        elif x["doc_id"] == 90:
            assert x["text"] is None and x["_removed"] == 0
        else:
            t = next(t for i, t, *_ in rows if i == x["doc_id"])
            assert x["text"] == "\n".join(y for k, y in enumerate(t.split("\n")) if not y.strip() or (x["doc_id"], k) in keep)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0

def test_line_dedup_long(spark):
    r = random.Random(11)
    made = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(900)]
    words = lambda n: [r.choice(made) for _ in range(n)]

    def replaced(w, many):
        w = list(w)
        for k in r.sample(range(len(w)), many):
            w[k] = "zq" * 5
        return w

    # words of a line, words replaced, whether the later line goes: one word for 16, at any place, grown with the length
    cases = [(n, 1, True) for n in (16, 20, 27, 31, 60) for _ in range(6)]
    cases += [(n, n.bit_length() > 4 and (1 << (n.bit_length() - 1)) // 16, True) for n in (33, 66, 130, 255, 256, 300, 600) for _ in range(3)]
    cases += [(n, n // 8 + 2, False) for n in (16, 31, 66, 130, 300, 600)]
    rows = []
    for i, (n, many, _) in enumerate(cases):
        w = words(n)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(replaced(w, many)))]
    moved = words(40)  # one word dropped at the start and one added at the end
    rows += [(1000, " ".join(moved)), (1001, " ".join([*moved[1:], "zqzqzqzqzq"]))]
    typed = "".join(r.choice("abcdefgh") for _ in range(70))  # four characters of a line without spaces
    rows += [(1002, typed), (1003, "x" + typed[1:20] + "y" + typed[20:50] + "z" + typed[51:69] + "u")]
    got = {x["doc_id"]: x["_removed"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k, _ in rows} | {2 * i + 1: int(gone) for i, (_, _, gone) in enumerate(cases)} | {1001: 1, 1003: 1}


def test_line_dedup_repeated_ids(spark):
    a, b, c = "the first line of all, which is long enough", "another line, unlike anything else that is here", "short"
    rows = [(1, a), (2, a + "x"), (2, b), (2, b), (3, c), (3, f"{c}\n{b}z\nnew")]
    got = sorted((x["doc_id"], x["text"]) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(1, a), (2, ""), (2, b), (2, b), (3, c), (3, "new")] or got == [(1, a), (2, ""), (2, b), (2, b), (3, ""), (3, f"{c}\nnew")]


def test_line_dedup_clashing_columns(spark, tmp_path, monkeypatch):
    """Columns with any name stay as they are, and what the operator has written is deleted but for what its result reads."""
    names = ["_id", "_doc", "_kept", "_left", "id", "doc", "kept", "pos", "line", "h", "g", "row", "left", "k_id", "key", "a.b"]
    a, b = "the first line of all, which is long enough", "another line, unlike anything else that is here"
    rows = [(k, t, *[f"{n}{k}" for n in names], 7, 8) for k, t in enumerate([a, f"{a}x\n{b}", None, "", b])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names) + ", _lines int, _removed int")
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    left = sorted(n.rsplit("-", 1)[0] for n in os.listdir(tmp_path))
    bare = line_dedup.dedup_lines(df, counts=False)
    plain = sorted(map(tuple, bare.collect()), key=str)
    found = {x["doc_id"]: x for x in got.collect()}
    assert left == ["edges", "kept"]
    assert [found[k]["text"] for k in range(5)] == [a, b, None, "", ""]
    assert [(found[k]["_lines"], found[k]["_removed"]) for k in range(5)] == [(1, 0), (2, 1), (0, 0), (1, 0), (1, 1)]
    for k, x in found.items():
        assert [x[n] for n in names] == [f"{n}{k}" for n in names]
    assert bare.columns == df.columns and [x[-2:] for x in plain] == [(7, 8)] * 5


def test_line_dedup_hot_keys(spark, monkeypatch):
    """Keys with more lines than ``FEW`` are divided by further segments; the links stay whole."""
    monkeypatch.setattr(line_dedup, "FEW", 3)
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    heads = ["a head that very many lines share " * 2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21 w22 w23 w24 ", " ".join(word() for _ in range(200)) + " "]
    rows = []
    for head in heads:
        tails = [" ".join(word() for _ in range(r.choice([4, 8, 12]))) for _ in range(9)]
        for tail in tails:
            for _ in range(2):
                x = list(head + tail)
                for _ in range(r.choice([0, 1, 2, 3])):
                    k = r.randrange(len(x))
                    x[k : k + r.randint(0, 1)] = r.choice(["", "z", " "])
                rows.append("".join(x))
    rows = list(dict.fromkeys(rows))
    lines = spark.createDataFrame([(x,) for x in rows], "line string").withColumn("h", F.xxhash64("line"))
    found = {x["h"]: x["line"] for x in lines.collect()}

    def close(a, b):
        n, w = min(len(a), len(b)), [a.split(" "), b.split(" ")]
        few = min(map(len, w))
        return edit(a, b) <= (4 if n >= 64 else 2) or few >= 16 and edit(*w) <= (1 << (few.bit_length() - 1)) // 16

    chars, words = line_dedup.budgets(None, line_dedup.MIN_CHARS)
    links = [(found[x["a"]], found[x["b"]]) for x in line_dedup.near_links(lines, chars, words).collect()]
    assert links and all(close(a, b) for a, b in links)
    want = roots(rows, [(a, b) for n, a in enumerate(rows) for b in rows[:n] if close(a, b)])
    got = roots(rows, links)
    group = lambda of: sorted(sorted(x for x in rows if of[x] == k) for k in set(of.values()))
    assert group(got) == group(want)


def test_line_dedup_large_group(spark):
    """Lines of a large group that are not near its head meet those with the same changes, not all others."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    top = [word() for _ in range(100)]
    lines = [" ".join(top)]
    for k in range(120):
        x = list(top)
        for at in r.sample(range(100), 6):
            x[at] = word()
        y = list(x)
        y[r.randrange(100)] = word()
        lines += [" ".join(x), " ".join(y)] if k < 20 else [" ".join(x)]
    texts = line_dedup.signed(spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line")).cache()
    head = texts.where(F.col("line") == lines[0]).first()["h"]
    rows = texts.where(F.col("h") != head).select(F.lit(head).alias("head"), F.lit(line_dedup.BY_BOTH).alias("kind"), F.lit(0).alias("part"), "h", F.struct(*line_dedup.MARKS).alias("x"), F.lit(False).alias("done"))
    keyed = line_dedup.told_apart(rows, texts, line_dedup.budgets(None, line_dedup.MIN_CHARS)[0]).select("key", "h").distinct()
    by_word = keyed.join(keyed.withColumnRenamed("h", "o"), "key").where("h < o").select("h", "o").distinct()
    found = {x["h"]: x["line"] for x in texts.collect()}
    pairs = {frozenset((found[x["h"]], found[x["o"]])) for x in by_word.collect()}
    # of 9,730 pairs; all within the budget are among them
    assert {frozenset(lines[k : k + 2]) for k in range(1, 41, 2)} <= pairs and len(pairs) < 2000


def test_line_dedup_distance(spark):
    r = random.Random(1)
    rows = []
    for _ in range(200):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 40)))
        b = list(a)
        for _ in range(r.randint(0, 7)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice(["", "a", "z"])
        rows.append((list(a), b) if len(a) >= len(b) else (b, list(a)))
    rows = [([c for c in a if c], [c for c in b if c]) for a, b in rows]
    rows = [(a, b) if len(a) >= len(b) else (b, a) for a, b in rows]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>")
    for k in (1, 4, 16, 30):
        for (a, b), got in zip(rows, df.select(F.expr(line_dedup.distance("x", "y", k)).alias("d")).collect(), strict=True):
            assert min(got["d"], k + 1) == min(edit(a, b), k + 1)


def test_line_dedup_class_borders(spark):
    """Near copies are found at every length, also where the two lines are in different classes."""
    r = random.Random(23)
    rows = []
    for n in (*range(32, 70), *range(78, 84), *range(94, 100), *range(110, 116), *range(126, 132), *range(158, 164), 255, 257, 511, 513, 700):
        a = "".join(r.choice("abcdefghijklmnop") for _ in range(n))
        b = list(a)
        for k in r.sample(range(n), 4 if n >= 64 else 2):
            b[k] = r.choice(["", "z", b[k] + "z"])
        rows += [a, "".join(b)]
    lines = spark.createDataFrame([(x,) for x in rows], "line string").withColumn("h", F.xxhash64("line"))
    found = {x["h"]: x["line"] for x in lines.collect()}
    got = {frozenset((found[x["a"]], found[x["b"]])) for x in line_dedup.near_links(lines, *line_dedup.budgets(None, line_dedup.MIN_CHARS)).collect()}
    near = lambda a, b: min(len(a), len(b)) >= 32 and edit(a, b) <= (4 if min(len(a), len(b)) >= 64 else 2)
    assert got == {frozenset(rows[k : k + 2]) for k in range(0, len(rows), 2) if near(*rows[k : k + 2])}


def test_line_dedup_wide_buckets(spark):
    """Long lines within the budget of the shorter one share a span of sizes."""
    r = random.Random(2)
    sizes = [(n, n + r.randint(0, (1 << (n.bit_length() - 1)) // 16)) for n in [*range(256, 300), *range(500, 530), *(r.randrange(256, 40000) for _ in range(300))]]
    got = spark.createDataFrame(sizes, "x int, y int").select("x", "y", line_dedup.wide_buckets(F.col("x")).alias("a"), line_dedup.wide_buckets(F.col("y")).alias("b")).collect()
    assert all(set(g["a"]) & set(g["b"]) and len(g["a"]) <= 2 for g in got)


def test_line_dedup_pairs_once(spark, monkeypatch):
    """Lines that share many keys meet once for these, and long lines of other repeated words do not meet at all."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    top = [word() for _ in range(120)]
    near = [" ".join([*top[:k], word(), word(), word(), *top[k + 3 :]]) for k in range(0, 120, 6)]
    junk = [" ".join(["Same"] * 40 + [w] * (600 + k % 3)) for k, w in enumerate("LaX UnX DeX AtreX AndX BleX WasX EdstndX EtX ThX OrX InX".split())]
    made = []
    crossed = line_dedup._crossed

    def counted(*args):
        out = crossed(*args)
        made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(line_dedup, "_crossed", counted)
    lines = spark.createDataFrame([(x,) for x in [*near, *junk]], "line string").withColumn("h", F.xxhash64("line"))
    found = {x["h"]: x["line"] for x in lines.collect()}
    links = {frozenset((found[x["a"]], found[x["b"]])) for x in line_dedup.near_links(lines, *line_dedup.budgets(None, line_dedup.MIN_CHARS)).collect()}
    want = {frozenset((a, b)) for n, a in enumerate(near) for b in near[:n] if edit(a.split(" "), b.split(" ")) <= 4}
    assert links <= want and all(x in junk or any(x in pair for pair in links) == any(x in pair for pair in want) for x in near)
    assert sum(rows for rows, _ in made) <= 8 * max(1, sum(pairs for _, pairs in made))
    # of 66 pairs of junk, those whose words are in one of twelve classes of the hash
    texts = line_dedup.signed(lines.where(F.col("line").isin(junk)))
    a, b = (texts.select(F.struct("h", *line_dedup.MARKS).alias(n)) for n in "ab")
    assert a.join(b, (F.col("a.h") < F.col("b.h")) & line_dedup.plausible("a", "b", line_dedup.CHARS, True)[1]).count() < 20


def test_line_dedup_one_class(spark, monkeypatch):
    """Lines that their heads have joined do not meet again; what tells a line apart is a few rows a line, however large its group."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    top = [word() for _ in range(75)]
    added = []
    for _ in range(40):
        x = list(top)
        for k in (20, 40, 60):
            x.insert(k + r.randrange(6), word())
        added.append(" ".join(x))
    made = []
    crossed = line_dedup._crossed
    monkeypatch.setattr(line_dedup, "_crossed", lambda *args: made.append(crossed(*args)) or made[-1])
    counts = []
    materialize = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, tag: counts.extend(x.count() for x in made if tag == "pairs") or materialize(df, tag))
    # the text of the others stands twice, so it is the head where it has a part; in the other part of its keys it is not
    lines = spark.createDataFrame([(x,) for x in [" ".join(top)] * 2 + added], "line string").withColumn("h", F.xxhash64("line"))
    links = line_dedup.near_links(lines, *line_dedup.budgets(None, line_dedup.MIN_CHARS)).collect()
    assert len(set(roots({x["h"] for x in lines.collect()}, [(x["a"], x["b"]) for x in links]).values())) == 1
    assert counts and sum(counts) == 0

    long = [word() for _ in range(140)]
    texts = line_dedup.signed(spark.createDataFrame([(" ".join([*long[:k], word(), *long[k + 1 :]]),) for k in range(50)], "line string").select(F.xxhash64("line").alias("h"), "line")).cache()
    head = texts.agg(F.max("h")).first()[0]
    rows = texts.where(F.col("h") != head).select(F.lit(head).alias("head"), F.lit(line_dedup.BY_MORE).alias("kind"), F.lit(0).alias("part"), "h", F.struct(*line_dedup.MARKS).alias("x"), F.lit(False).alias("done"))
    assert line_dedup.told_apart(rows, texts, line_dedup.CHARS).count() == 49 * (line_dedup.MORE + 1)


def test_line_dedup_rulers():
    """Of every segment a line gives few parts, and two lines with the segment at any shift that edits leave have one in common."""
    for m in range(40):
        marks = line_dedup.ruler(m)
        assert max(marks) == m and {abs(a - b) for a in marks for b in marks} == set(range(m + 1)) and len(marks) <= 2 * m**0.5 + 1
    assert [len(line_dedup.places(k)) for k in (1, 2, 4, 8)] == [2, 4, 9, 22]
    for least, edits, gap in ((32, 2, 0), (64, 4, 0), (32, 4, 1), (64, 4, 1), (128, 8, 1)):
        plan = line_dedup.plan_of(least, edits, 0, gap)
        spans = {}
        for i, at, w in plan:
            start = at - 1 if at > 0 else least + at
            lo, hi = spans.get(i, (least, 0))
            spans[i] = (min(lo, start), max(hi, start + w))
        edges = [spans[i] for i in sorted(spans)]
        assert len(edges) == edits + 1 and edges[0][0] >= 0 and edges[-1][1] <= least
        assert all(a[1] + gap <= b[0] for a, b in zip(edges, edges[1:], strict=False))


def test_line_dedup_shared_change(spark):
    """A change that two lines of a large group share is found at whatever place of their lists it is, once for a line and head of all kinds and sizes."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    top = [word() for _ in range(20)]
    lines = [" ".join(top)]
    shared = word()
    for _ in range(24):
        lines.append(" ".join([*top[:9], shared, word(), *top[11:]]))
    texts = line_dedup.signed(spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line")).cache()
    head = texts.where(F.col("line") == lines[0]).first()["h"]
    one = texts.where(F.col("h") != head).select(F.lit(head).alias("head"), "h", F.struct(*line_dedup.MARKS).alias("x"), F.lit(False).alias("done"))
    group = lambda kind, part: one.select("head", F.lit(kind).alias("kind"), F.lit(part).alias("part"), "h", "x", "done")
    words = group(line_dedup.BY_WORDS, 5)
    keyed = line_dedup.told_apart(words, texts, line_dedup.CHARS)
    assert keyed.groupBy("key").agg(F.countDistinct("h").alias("n")).agg(F.max("n")).first()[0] == 24
    twice = words.unionByName(group(line_dedup.BY_WORDS, 6)).unionByName(group(line_dedup.BY_CHARS, 7))
    assert line_dedup.told_apart(twice, texts, line_dedup.CHARS).count() <= 24 * (2 + 13)


def test_line_dedup_shared_once(spark):
    """Lines that share several changes against their head are paired once, and no pair that shares any is lost."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    top = [word() for _ in range(40)]
    shared = [word() for _ in range(8)]
    lines = [" ".join(top), *(" ".join([*shared, *top[8:20], word(), *top[21:]]) for _ in range(20))]
    texts = line_dedup.signed(spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line")).cache()
    head = texts.where(F.col("line") == lines[0]).first()["h"]
    rows = texts.where(F.col("h") != head).select(F.lit(head).alias("head"), F.lit(line_dedup.BY_BOTH).alias("kind"), F.lit(0).alias("part"), "h", F.struct(*line_dedup.MARKS).alias("x"), F.col("h").alias("root"), F.lit(False).alias("done"))
    keyed = line_dedup.told_apart(rows, texts, line_dedup.CHARS).cache()
    every = keyed.select("key", "h").join(keyed.select("key", F.col("h").alias("o")), "key").where("h < o").select("h", "o")
    made = [(x["a"], x["b"]) for x in line_dedup._crossed(keyed, line_dedup.CHARS, True).collect()]
    assert every.count() > 2 * every.distinct().count() and sorted(made) == sorted(map(tuple, every.distinct().collect()))
    assert len(made) == 190


def test_line_dedup_texts_sent_once(spark, monkeypatch):
    """The bitmap drops texts before they are sent: no join with the lines looked for lies beneath it, whatever their number."""
    plans = []
    materialize = line_dedup.materialize

    def seen(df, tag):
        if tag == "texts":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, tag)

    monkeypatch.setattr(line_dedup, "materialize", seen)
    rows = [f"line {k} that shares its start and its end with all of the others, but for a number {k % 7}" for k in range(20)]
    lines = spark.createDataFrame([(x,) for x in rows], "line string").withColumn("h", F.xxhash64("line"))
    assert line_dedup.near_links(lines, *line_dedup.budgets(None, line_dedup.MIN_CHARS)).count()
    joins = [x.strip(" :+-") for x in plans[0].split("\n") if "Join" in x]
    # from the top: with the lines looked for, then with the bitmap
    assert len(joins) == 2 and "rightHint" not in joins[0] and "broadcast" in joins[1], plans[0]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


@pytest.mark.parametrize("paired", [64, 3])
def test_jaccard(spark, monkeypatch, paired):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 12)  # so that groups are cut into blocks
    monkeypatch.setattr(jaccard, "PAIRED", paired)  # and, if it is small, that lists are chained
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    bases = [[word() for _ in range(r.choice([30, 80, 200]))] for _ in range(5)]
    texts = []
    for _ in range(110):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = word()
        texts.append(r.choice([" ", "\n", " \t"]).join(w))
    texts += [None, "", "a b c", "A  b\nc", "a b", "Ä b c", " "] + [" ".join(word() for _ in range(40)) for _ in range(30)]
    rows = [(i * 3 % 1000, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, n int").repartition(4)
    sets = {i: shingles(t) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    find, least = roots(sets, links), {}
    for n, k in find.items():
        least[k] = min(least.get(k, n), n)
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == len(rows) + 1 and len(links) > 100
    for x in got:
        assert (x["n_shingles"], x["component_id"]) == (len(sets[x["doc_id"]]), least[find[x["doc_id"]]])
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(least.values()))
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_without_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (4, text), (None, "another text that stands alone here"), (2, text + " x")], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["component_id"]) for x in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (4, 2), (2, 2)], key=str)
    assert sorted((x["doc_id"] for x in jaccard.one_of_each(df).collect()), key=str) == [2, None, None]


def test_meetings(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "PAIRED", 4)
    r = random.Random(2)
    for _ in range(300):
        n = np.array(sorted(r.choice([10, 11, 12, 14, 30, 31, 90]) + r.randint(0, 2) for _ in range(r.randint(2, 25))))
        pairs, chain = jaccard.meetings(n, np.zeros(len(n), np.int64))
        find = roots(range(len(n)), pairs + chain)
        assert all(find[i] == find[k] for i in range(len(n)) for k in range(i + 1, len(n)) if 4 * n[k] <= 5 * n[i])
        assert len(chain) < len(n) and len(pairs) <= 4 * len(n)


def test_prefix_length():
    for a in range(1, 200):
        need = -(-4 * a // 5)
        assert jaccard.prefix_length(a) == a - need + 1


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "123 !?", "en"), (-3, "", None), (-4, "x", None)], "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").unionByName(odd)
    model = langid.fit_languages(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in got if x["held_out"] and x["doc_id"] >= 0]
    assert sum(x["lang_pred"] == x["lang"] for x in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got) and {x["doc_id"] for x in got if x["lang_pred"] == "und"} == {-1, -2, -3}
    by_lang = {r["lang"]: r["text"] for r in docs.where("lang is not null and length(text) > 800").collect()}
    name, share, chosen = model(by_lang["en"][:800] + " " + by_lang["de"][:800])
    assert {k for k, _ in chosen} == {"de", "en"} and 0.3 < share < 0.7
    assert langid.fit_languages(docs.limit(0))("some text") == ("und", 0.0, [])


def test_quality_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    model = quality_model.fit_quality(docs, labels)
    got = {x["doc_id"]: x for x in quality_model.score_documents(rows, model).collect()}
    held = [(got[x["doc_id"]], x["quality"]) for x in labels.collect() if got[x["doc_id"]]["held_out"]]
    assert sum(a["predicted"] == b for a, b in held) / len(held) > 0.93
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values()) and got[-1]["score"] == got[-2]["score"]
    assert quality_model.fit_quality(docs, labels.limit(0)).probability(model.pool(quality_model.word_rows("", quality_model._Rows()))[None])[0] == 0.5


def test_quality_model_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("score", F.lit(1))
    once, twice = quality_model.fit_quality(docs, labels), quality_model.fit_quality(docs, labels.unionByName(labels))
    score = lambda m, d: sorted(map(tuple, quality_model.score_documents(d, m).collect()))
    assert score(once, docs) == score(twice, docs)
    some = docs.limit(3).cache()
    assert score(once, some.unionByName(some)) == sorted(score(once, some) * 2) and not score(once, docs.limit(0))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in p.STAGES[:-1]:
        new = stage(spark, at, SF).cache()
        assert new.dtypes == docs.dtypes, name
        assert {x["doc_id"] for x in new.select("doc_id").collect()} <= {x["doc_id"] for x in at.select("doc_id").collect()}
        assert not new.where(F.length("text") != F.col("n_chars")).count()
        at = new
    pieces = p.STAGES[-1][1](spark, at, SF)
    assert {x["doc_id"] for x in pieces.select("doc_id").distinct().collect()} == {x["doc_id"] for x in at.select("doc_id").collect()}
    assert p.run(spark, SF).count() == pieces.count()
