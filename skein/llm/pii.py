"""Personal data by boosted candidates: native SQL expressions from the text to the spans.

High-recall patterns propose spans, which may overlap. Each candidate has format features (digits, groups, checksum)
and context features (words before it, characters on either side). Boosted trees, fitted on the driver on generated
labelled snippets whose features the same SQL computes, score a candidate; a threshold for each kind, calibrated on
snippets that the trees have not seen, selects it. Of selected candidates that overlap, the set of the highest total
score stays. Matches of the base patterns are always reported, and candidates that touch one never.

Everything a document needs is computed in its own row, so the plan has no exchange and no Python.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed; the first four have a base pattern.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")

_LOCAL = "A-Za-z0-9._%+-"
#: Base patterns. The look-behind and \\G spare starts inside a run that has failed as a whole; a run of fewer than 12
#: digits can't be a card; both leave the leftmost matches as they are. Possessive groups do not recurse on long runs.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators beyond the base: (kind, cheap test of the text, pattern). They are generous; the trees decide.
GENERATORS = (
    ("email", r"(?i)(?:\[|\(|\{| )(?:at|dot)(?:\]|\)|\}| )", r"(?i)[A-Za-z0-9._%+-]{2,40} ?(?:\[at\]|\(at\)|\{at\}|\bat\b) ?[A-Za-z0-9-]{2,40} ?(?:\[dot\]|\(dot\)|\{dot\}|\bdot\b|\.) ?[A-Za-z]{2,12}"),
    ("ip", r"[0-9] ?(?:\[|\(|\{| )(?:\.|dot)", r"(?i)\b[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\bdot\b|\.) ?[0-9]{1,3}){3}\b"),
    ("phone", r"[0-9]{3}", r"(?:\([0-9]{2,5}\) ?|(?<![0-9][.-])\b[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}\b(?![.-]?[0-9])"),
    ("ssn", r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", r"\b[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}\b"),
    ("card", r"[0-9]{4}[./][0-9]{4}", r"\b[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{1,7}\b"),
    ("iban", r"[A-Z]{2}[0-9]{2}", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
)
#: Words before a candidate that speak for a kind; fixed values.
HINTS = {
    "email": r"(?i)(?:mail|contact|write|reach)",
    "ip": r"(?i)(?:ip|host|server|from|address)",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|pay)",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|dial|whatsapp)",
    "ssn": r"(?i)(?:ssn|social|security|tax)",
    "iban": r"(?i)(?:iban|account|bank|transfer|konto|compte|cuenta)",
    "other": r"(?i)(?:order|invoice|version|isbn|part|serial|page|ref|item|sku|build|figure|section|no\.|nr\.|#)",
}
FEATURES = ("kind", "digits", "length", "seps", "groups", "luhn", "distinct", "zero", "marks", "hint", "against", "left", "right", "octets")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _lit(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _found(text: str, test: str, pattern: str) -> str:
    """Matches of a pattern with places (code points) and what stands on either side; empty if ``test`` fails."""
    p = _lit(pattern)
    kind = "array<struct<s:bigint,e:bigint,m:string,b:string,a:string>>"
    step = "named_struct('s', acc.at + length(x.p), 'e', acc.at + length(x.p) + length(x.m), 'm', x.m, 'b', right(x.p, 28), 'a', left(x.n, 6))"
    walk = f"""aggregate(transform(hit, (m, i) -> named_struct('p', cut[i], 'm', m, 'n', cut[i + 1])), named_struct('at', 0L, 'out', cast(array() as {kind})),
        (acc, x) -> named_struct('at', acc.at + length(x.p) + length(x.m), 'out', concat(acc.out, array({step}))), acc -> acc.out)"""
    return f"if({test}, {_let('hit', f'regexp_extract_all({text}, {p}, 0)', _let('cut', f'split({text}, {p}, -1)', walk))}, cast(array() as {kind}))"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """1 if the digits ``d`` pass the check sum, else 0."""
    twice = _let("v", f"cast(substring({d}, length({d}) - i + 1, 1) as int)", "if(i % 2 = 0, if(v > 4, v * 2 - 9, v * 2), v)")
    return f"if(length({d}) > 0 and aggregate(sequence(1, greatest(length({d}), 1)), 0, (t, i) -> t + {twice}) % 10 = 0, 1, 0)"


def base_columns(text: str = "text") -> dict[str, str]:
    """SQL of the base spans by kind: matches that pass the kind's test, as found."""
    keep = {
        "email": "true",
        "ip": "forall(split(c.m, '[.]'), x -> coalesce(try_cast(x as bigint) <= 255, false))",
        "card": _let("d", _digits("c.m"), f"length(d) between 12 and 19 and {_luhn('d')} = 1"),
        "phone": f"length({_digits('c.m')}) between 9 and 15",
    }
    test = {"email": f"contains({text}, '@')", "ip": f"{text} rlike {_lit('[0-9][.][0-9]')}", "card": f"{text} rlike {_lit('[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]')}", "phone": f"contains({text}, '+')"}
    return {k: f"filter({_found(text, test[k], p)}, c -> {keep[k]})" for k, p in BASE.items()}


def _featured(kind: str, found: str) -> str:
    """Candidates with the features of :data:`FEATURES`, in that order, as doubles."""
    number = KINDS.index(kind)
    values = [
        f"{number}D", "length(d)", "length(c.m)", "length(regexp_replace(c.m, '[^ ./()-]', ''))", "size(split(c.m, '[^0-9A-Za-z]+'))", _luhn("d"),
        "size(array_distinct(split(d, '')))", "if(d like '0%', 1, 0)", "if(c.m rlike '[+@(\\\\[{]', 1, 0)", f"if(c.b rlike {_lit(HINTS[kind])}, 1, 0)",
        f"if(c.b rlike {_lit(HINTS['other'])}, 1, 0)", "if(c.b rlike '[0-9A-Za-z$#./-]$', 1, 0)", "if(c.a rlike '^[0-9A-Za-z%/-]', 1, 0)",
        "if(forall(filter(split(c.m, '[^0-9]+'), x -> x <> ''), x -> coalesce(try_cast(x as bigint) <= 255, false)), 1, 0)",
    ]
    array = "array(" + ", ".join(f"cast({v} as double)" for v in values) + ")"
    row = _let("d", _digits("c.m"), f"named_struct('k', {number}, 's', c.s, 'e', c.e, 'f', {array})")
    return f"transform({found}, c -> {row})"


def generated_columns(text: str = "text") -> list[str]:
    """SQL of the candidates of each generator, with features."""
    return [_featured(kind, _found(text, f"{text} rlike {_lit(test)}", pattern)) for kind, test, pattern in GENERATORS]


class Trees:
    """Boosted regression trees on the log-loss, depth three, and a score threshold for each kind."""

    def __init__(self, rounds: int = 24, rate: float = 0.35, depth: int = 3) -> None:
        self.rounds, self.rate, self.depth, self.start, self.trees, self.limits = rounds, rate, depth, 0.0, [], {}

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        total, weight = g.sum(), h.sum()
        best, gain = None, 1e-6
        if depth:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, gs, hs = x[order, f], g[order].cumsum()[:-1], h[order].cumsum()[:-1]
                ok = v[1:] > v[:-1]
                if ok.any():
                    score = gs**2 / (hs + 1) + (total - gs) ** 2 / (weight - hs + 1) - total**2 / (weight + 1)
                    score[~ok] = 0
                    i = int(score.argmax())
                    if score[i] > gain:
                        best, gain = (f, float(v[i] + v[i + 1]) / 2), float(score[i])
        if best is None:
            return float(total / (weight + 1))
        left = x[:, best[0]] < best[1]
        return (*best, self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _tree(self, node, x: np.ndarray) -> np.ndarray:
        if isinstance(node, float):
            return np.full(len(x), node)
        return np.where(x[:, node[0]] < node[1], self._tree(node[2], x), self._tree(node[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray, precision: float = 0.95) -> Trees:
        """Trees from half of the rows; limits from the rest: the lowest score from which on the share of
        true candidates of the kind is ``precision`` or more, but none that is more likely false than true. Without such a score, no candidate of the kind passes."""
        held = np.random.default_rng(1).random(len(y)) < 0.5
        a, b = x[~held], y[~held]
        self.start = float(np.log(b.mean() / (1 - b.mean())))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-self.score(a)))
            self.trees.append(self._grow(a, b - p, p * (1 - p), self.depth))
        s = self.score(x[held])
        for k in range(len(KINDS)):
            mine = x[held][:, 0] == k
            order = np.argsort(-s[mine], kind="stable")
            good = np.cumsum(y[held][mine][order]) / (np.arange(mine.sum()) + 1)
            passing = np.flatnonzero(good >= precision)
            self.limits[k] = max(0.0, float(s[mine][order][passing[-1]])) if len(passing) else 1e9
        return self

    def sql(self, f: str) -> str:
        """The score of a feature array as SQL."""

        def one(node) -> str:
            return f"{node:.6g}D" if isinstance(node, float) else f"if({f}[{node[0]}] < {node[1]:.6g}D, {one(node[2])}, {one(node[3])})"

        return f"{self.start:.6g}D + {self.rate}D * (" + " + ".join(map(one, self.trees)) + ")"


def snippets(n: int = 3600, seed: int = 3) -> list[tuple[str, str, int]]:
    """Generated labelled snippets (kind, text, label): personal data in their forms, and numbers that are none.

    The two do not part cleanly: a tenth of the true ones has no hint before it, some of them a word that speaks against;
    some of the others have a hint, and many share the form of the true ones. So the trees weigh, and limits matter.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9)))
    part = lambda: str(r.randint(0, 255))

    def card() -> str:
        body = r.choice("3456") + d(14)
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(body))
        return body + str(-total % 10)

    def iban() -> str:
        return r.choice(["DE", "FR", "ES", "GB"]) + d(2) + "".join(" " * r.randint(0, 1) + d(4) for _ in range(4)) + " " + d(2)

    def joined(numbers: list[str], marks: list[str]) -> str:
        mark = r.choice(marks)
        return mark.join(numbers)

    hints = {
        "email": ["mail", "contact", "write to", "reach me:"], "phone": ["tel", "phone:", "call me at", "fax", "mobile"], "ssn": ["ssn", "social security number", "tax id"],
        "card": ["card", "visa", "credit card", "paid by"], "iban": ["iban", "bank account", "transfer to"], "ip": ["ip", "host", "server at", "from address"],
    }
    against = ["order", "version", "part", "page", "ref", "serial", "build", "sku", "section", "item"]
    true = {
        "email": lambda: f"{w()}{r.choice([' [at] ', '(at)', ' at ', '[at]'])}{w()}{r.choice([' [dot] ', '(dot)', ' dot ', '.'])}{r.choice(['com', 'org', 'net', 'de'])}",
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"]),
        "ssn": lambda: r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}"]),
        "card": lambda: (lambda c: joined([c[:4], c[4:8], c[8:12], c[12:]], [".", "/"]))(card()),
        "iban": iban,
        "ip": lambda: joined([part() for _ in range(4)], ["[.]", "(.)", " dot ", "[dot]", "{.}"]),
    }
    false = {
        "email": lambda: f"{w()} at {w()} {r.choice(['. ', 'dot '])}{w()[:5]}",
        "phone": lambda: r.choice([f"{d(4)}.{d(3)}.{d(3)}", f"{d(2)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}"]),
        "ssn": lambda: r.choice([f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}"]),
        "card": lambda: joined([d(4) for _ in range(4)], [".", "/"]),
        "iban": lambda: r.choice(["AB", "XQ", "ZT", "DE"]) + d(2) + "".join(" " + "".join(r.choice("ABCDEFGH23456789") for _ in range(4)) for _ in range(3)),
        "ip": lambda: joined([str(r.randint(0, 999)) for _ in range(4)], ["[.]", "(.)", " dot ", " . "]),
    }
    out = []
    for i in range(n):
        kind = list(true)[i % len(true)]
        label = int(r.random() < 0.5)
        u = r.random()
        if label:
            lead = r.choice(hints[kind]) if u < 0.9 else r.choice(against) if u < 0.92 else w()
        else:
            lead = r.choice(against) if u < 0.5 else r.choice(hints[kind]) if u < 0.53 else w()
        out.append((kind, f"{w()} {w()} {lead} {(true if label else false)[kind]()} {w()} {w()}.", label))
    return out


_FITTED: dict[tuple[int, int], Trees] = {}


def fit_trees(spark: SparkSession, n: int = 3600, seed: int = 3) -> Trees:
    """Trees fitted on ``n`` generated snippets; a fit of the same parameters is kept for the process."""
    if (n, seed) not in _FITTED:
        rows = json.dumps([{"k": KINDS.index(k), "text": t, "y": y} for k, t, y in snippets(n, seed)])
        data = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<k:int,text:string,y:int>>")))
        found = data.select("k", "y", F.explode(F.expr(f"concat({', '.join(generated_columns())})")).alias("c")).where("c.k = k").select("c.f", "y").collect()
        x = np.array([r[0] for r in found], float)
        _FITTED[n, seed] = Trees().fit(x, np.array([r[1] for r in found], float))
    return _FITTED[n, seed]


def _selected(spans: str) -> str:
    """SQL of the candidates that stay, out of ``spans`` (array of ``s, e, k, w``; base spans have a null ``w``): those
    that touch no base span, and of those that overlap the set of the largest sum of ``w``.

    Spans are put in order of their start and fall into runs that do not touch; a run is settled by itself. Within a run,
    candidates in order of their end are added to the best set that ends before them.
    """
    kind = "struct<s:bigint,e:bigint,k:int,w:double>"
    runs = f"""aggregate(array_sort({spans}), named_struct('end', -1L, 'now', cast(array() as array<{kind}>), 'done', cast(array() as array<array<{kind}>>)),
        (r, x) -> if(x.s < r.end, named_struct('end', greatest(r.end, x.e), 'now', concat(r.now, array(x)), 'done', r.done),
            named_struct('end', x.e, 'now', array(x), 'done', if(size(r.now) = 0, r.done, concat(r.done, array(r.now))))),
        r -> if(size(r.now) = 0, r.done, concat(r.done, array(r.now))))"""
    plain = "filter(run, x -> x.w is not null and not exists(run, b -> b.w is null and b.s < x.e and x.s < b.e))"
    order = "array_sort(%s, (x, y) -> case when x.e < y.e then -1 when x.e > y.e then 1 when x.s < y.s then -1 when x.s > y.s then 1 else x.k - y.k end)" % plain
    start = f"array(named_struct('w', 0D, 'e', -1L, 'set', cast(array() as array<{kind}>)))"
    best = f"""array_max(aggregate({order}, {start}, (all, x) -> concat(all, transform(array(array_max(filter(all, o -> o.e <= x.s))), o -> named_struct('w', o.w + x.w, 'e', x.e, 'set', concat(o.set, array(x))))))).set"""
    return f"flatten(transform({runs}, run -> if(size(run) = 1, filter(run, x -> x.w is not null), {best})))"


def find_personal_data(docs: DataFrame, trees: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: base counts, digest of the base spans and all spans (code points).

    Returns the id, ``n_email, n_ip, n_card, n_phone`` (long), ``base_sha256``, ``spans``, and ``n_added`` (spans that
    the trees have selected; they overlap neither a base span nor each other). Map only, without Python. A null or empty text gives
    zeros, the digest of the empty string and ``""``; repeated rows give repeated results; an empty table gives no
    rows; further columns, whatever their names, are not read.
    """
    trees = trees or fit_trees(docs.sparkSession)
    base = base_columns("t")
    kind_of = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.k + 1)"
    plain = "named_struct('s', c.s, 'k', {k}, 'e', c.e)"
    limit = "element_at(array(" + ", ".join(f"{trees.limits.get(k, 1e9):.6g}D" for k in range(len(KINDS))) + "), c.k + 1)"
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    more = f"transform(filter(transform(concat({', '.join(generated_columns('t'))}), c -> named_struct('s', c.s, 'e', c.e, 'k', c.k, 'w', {trees.sql('c.f')})), c -> c.w >= {limit}), c -> named_struct('s', c.s, 'e', c.e, 'k', c.k, 'w', greatest(c.w, 0D) + 1D))"
    out = out.select(id_col, *[F.expr(f"transform({sql}, c -> {plain.format(k=KINDS.index(k))})").alias(f"b_{k}") for k, sql in base.items()], F.expr(more).alias("more"))
    out = out.select(id_col, *[f"b_{k}" for k in base], F.expr("array_sort(concat(" + ", ".join(f"b_{k}" for k in base) + "))").alias("base"), "more")
    every = "concat(transform(base, b -> named_struct('s', b.s, 'e', b.e, 'k', b.k, 'w', cast(null as double))), more)"
    added = f"if(size(more) = 0, cast(array() as array<struct<s:bigint,k:int,e:bigint>>), transform({_selected(every)}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e)))"
    out = out.select(id_col, *[F.expr(f"cast(size(b_{k}) as bigint)").alias(f"n_{k}") for k in base], "base", F.expr(added).alias("added"))
    joined = "array_join(transform({a}, x -> concat(" + kind_of + ", ':', x.s, ':', x.e)), ',')"
    return out.select(
        id_col, *[f"n_{k}" for k in base], F.sha2(F.expr(joined.format(a="base")), 256).alias("base_sha256"),
        F.expr(joined.format(a="array_sort(concat(base, added))")).alias("spans"), F.expr("cast(size(added) as bigint)").alias("n_added"),
    )
