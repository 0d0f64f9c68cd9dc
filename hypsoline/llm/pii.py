"""Personal data: candidate spans, boosted trees, calibrated thresholds; DataFrame operations only.

Base patterns give spans that always stay. Wider generators propose further, possibly overlapping spans; features of
their format and context go through a gradient-boosted ensemble, held as one expression, whose calibrated probability
must reach the threshold of its kind. The ensemble is trained from rows made by rule, with the same expressions.
"""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame, functions as F

from .common import col, small_table, unused

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, with possessive repeats and guards that change no match but keep matching linear.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must hold to be searched at all.
HINT = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]")

#: Generators: obfuscated and non-ASCII mail addresses, long IP addresses, cards with other separators, local phones.
WIDE = (
    r"(?i)(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++(?:@|\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[\p{L}\p{N}-]++(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)[\p{L}\p{N}-]++)++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z+])(?:\+|00)?\x20?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])",
)
WIDE_HINT = (r"(?i)@|\Wat\W", r":[0-9A-Fa-f]{1,4}:", r"[0-9][\x20./_-]{0,2}[0-9]", r"[0-9]\)?[\x20./-]\(?[0-9]")
CONTEXT = r"(?i)(phone|tel|call|mobile|fax|whatsapp|card|visa|master|amex|payment|mail|contact|write|reach|host|server|addr|login|from)"
AGAINST = r"(?i)(version|isbn|order|invoice|date|price|page|section|chapter|build|serial|ref|doi|total|figure|table)"

SPAN = "struct<a:int,k:int,b:int,t:string,c:string>"
#: Code points before a match that a span carries as its context, and those of a piece in which redaction cuts a text.
BEFORE, PIECE = 24, 256
#: Items that one array grows to before it is set aside.
CHUNK = 256


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def running(items: Column, state: dict[str, Column], step, kind: str) -> Column:
    """array<kind>: what step(state, item) -> (new state, made) makes of each item in turn.

    An array that grows is copied at every step, so items go in chunks, whose results are joined at the end: the work is in
    proportion to the items (their square / CHUNK**2 references, besides).
    """
    none = F.array().cast(f"array<{kind}>")

    def add(acc: Column, x: Column) -> Column:
        new, made = step(acc, x)
        return F.struct(*[new[n].alias(n) for n in state], F.array_append(acc["out"], made).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(*[acc[n].alias(n) for n in state], none.alias("out")), add)
        return bound(inner, lambda r: F.struct(*[r[n].alias(n) for n in state], F.array_append(acc["out"], r["out"]).alias("out")))

    def whole(every: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(every) / CHUNK).cast("int") - 1)
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(every, i * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(*[v.alias(n) for n, v in state.items()], F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(parts, start, chunk, lambda acc: acc["out"]))

    return bound(items, whole)


def matches(text: Column, pattern: str, hint: str, kind: int) -> Column:
    """array<SPAN>: leftmost non-overlapping matches with their code point offsets (end exclusive), kind, text, and the
    BEFORE code points before them."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    pairs = bound(found, lambda f: F.zip_with(f, F.slice(gaps, F.lit(1), F.size(f)), lambda t, g: F.struct(t.alias("t"), g.alias("g"))))

    def step(acc: Column, x: Column):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["t"])
        tail = F.right(F.concat(acc["tail"], F.right(x["g"], F.lit(BEFORE))), F.lit(BEFORE))
        span = F.struct(start.alias("a"), F.lit(kind).alias("k"), end.alias("b"), x["t"].alias("t"), tail.alias("c"))
        return {"at": end, "tail": F.right(F.concat(tail, F.right(x["t"], F.lit(BEFORE))), F.lit(BEFORE))}, span

    run = running(pairs, {"at": F.lit(0), "tail": F.lit("")}, step, SPAN)
    return F.when(text.rlike(hint), run).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        v = F.substr(d, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def passes(s: Column) -> Column:
    """The base rules: parts of an ip at most 255, 14 to 19 digits and Luhn's sum for a card, 10 to 15 for a phone."""
    t, k = s["t"], s["k"]
    ip = F.forall(F.split(t, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(digits(t))
    card = F.when(n.between(14, 19), luhn(digits(t))).otherwise(False)
    return F.when(k == 0, True).when(k == 1, ip).when(k == 2, card).otherwise(n.between(10, 15))


def base_spans(text: Column) -> Column:
    every = F.concat(*[matches(text, p, h, k) for k, (p, h) in enumerate(zip(BASE, HINT, strict=True))])
    return F.array_sort(F.filter(every, passes))


def count_of(t: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(t, f"[^{pattern}]", ""))


FEATURES = ("kind", "n_digits", "length", "letters", "seps", "dots", "plus", "parens", "at", "bracket", "luhn", "longest", "zero", "for_it", "against", "quad", "year")


def features(s: Column) -> Column:
    """array<double> in the order of FEATURES, of a candidate's own form and its context."""
    t, d, before = s["t"], digits(s["t"]), s["c"]
    n = F.length(d)
    longest = F.array_max(F.transform(F.split(t, "[^0-9]+"), lambda x: F.length(x)))
    values = (
        s["k"], n, F.length(t), count_of(t, "A-Za-z"), count_of(t, r"\x20./_-"), count_of(t, "."), t.startswith("+"), t.contains("("), t.contains("@"),
        t.rlike(r"[\[({]\x20?(?i:at|dot)"), F.when(n.between(13, 19), luhn(d)).otherwise(False), F.coalesce(longest, F.lit(0)), d.startswith("0"),
        before.rlike(CONTEXT), before.rlike(AGAINST), t.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), t.rlike(r"^(?:19|20)[0-9]{2}[./-]|[./-](?:19|20)[0-9]{2}$"),
    )
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def candidates(text: Column) -> Column:
    """Wide spans with their features."""
    every = F.concat(*[matches(text, p, h, k) for k, (p, h) in enumerate(zip(WIDE, WIDE_HINT, strict=True))])
    return F.transform(every, lambda s: F.struct(s["a"].alias("a"), s["k"].alias("k"), s["b"].alias("b"), s["t"].alias("t"), features(s).alias("f")))


def examples(n: int = 60, seed: int = 7) -> list[dict]:
    """Labelled texts made by rule: {text, kind, y}; the span is what the generators find in the text."""
    rng = random.Random(seed)
    dig = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9)))

    def checked(k: int, good: bool) -> str:
        d = rng.choice("3456") + dig(k - 2)
        s = sum(v if i % 2 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d))))
        last = -s % 10
        return d + str(last if good else (last + rng.randint(1, 9)) % 10)

    def fours(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    out = []
    for _ in range(n):
        w, v, z = word(), word(), word()
        call = rng.choice(("phone ", "tel. ", "call ", "mobile: "))
        odd = rng.choice((". ", "_", "/"))
        out += [
            {"text": f"{w} {v}.{z} [at] {word()} [dot] com {w}", "kind": 0, "y": 1},
            {"text": f"mail {v}(at){word()}.org, {w}", "kind": 0, "y": 1},
            {"text": f"contact {v}é@{word()}.de {w}", "kind": 0, "y": 1},
            {"text": f"mail {v} at {word()} dot com {w}", "kind": 0, "y": 1},
            {"text": f"{w} {v} at {word()}.{word()} {w}", "kind": 0, "y": 0},
            {"text": f"{w} {v} at {word()} dot {word()} {w}", "kind": 0, "y": 0},
            {"text": f"{w} " + ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)) + f" {v}", "kind": 1, "y": 1},
            {"text": f"{w} " + ":".join(dig(2) for _ in range(8)) + f" {v}", "kind": 1, "y": 0},
            {"text": f"card {fours(checked(16, True), '.')} {v}", "kind": 2, "y": 1},
            {"text": f"{w} payment {fours(checked(16, True), odd)} {v}", "kind": 2, "y": 1},
            {"text": f"{w} {fours(checked(16, False), rng.choice(('', ' ', '.')))} {v}", "kind": 2, "y": 0},
            {"text": f"{w} order {checked(13, rng.random() < 0.5)} {v}", "kind": 2, "y": 0},
            {"text": f"{w} {dig(14)} {v}", "kind": 2, "y": 0},
            {"text": f"{call}({rng.randint(2, 9)}{dig(2)}) 555-{dig(4)} {v}", "kind": 3, "y": 1},
            {"text": f"{w} ({rng.randint(2, 9)}{dig(2)}) {dig(3)}-{dig(4)} {v}", "kind": 3, "y": 1},
            {"text": f"{call}{rng.randint(2, 9)}{dig(2)}-{dig(3)}-{dig(4)} {v}", "kind": 3, "y": 1},
            {"text": f"{call}0049 30 {dig(4)} {dig(3)} {v}", "kind": 3, "y": 1},
            {"text": f"{w} {rng.choice(('19', '20'))}{dig(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {v}", "kind": 3, "y": 0},
            {"text": f"{w} {rng.randint(10, 28)}.{rng.randint(10, 12)}.20{dig(2)} {v}", "kind": 3, "y": 0},
            {"text": f"{w} {rng.randint(1, 255)}.{rng.randint(10, 255)}.{rng.randint(10, 255)}.{rng.randint(10, 255)} {v}", "kind": 3, "y": 0},
            {"text": f"version {rng.randint(1, 20)}.{dig(2)}.{dig(3)} {v}", "kind": 3, "y": 0},
            {"text": f"{w} {fours(checked(16, rng.random() < 0.5), ' ')} {v}", "kind": 3, "y": 0},
            {"text": f"{w} {dig(3)} {dig(3)} {dig(3)} {v}", "kind": 3, "y": 0},
            {"text": f"isbn 978-{dig(2)}-{dig(4)}-{dig(3)} {v}", "kind": 3, "y": 0},
            {"text": f"{w} {dig(2)} {dig(2)} {dig(2)} {dig(2)} {v}", "kind": 3, "y": 0},
        ]
    return out


Tree = tuple


def _leaf(g: list[float], h: list[float], rows: list[int]) -> float:
    return sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1.0)


def _grow(x: list[list[float]], g: list[float], h: list[float], rows: list[int], depth: int) -> Tree:
    """A regression tree by the usual gain of gradients g and curvatures h: (feature, cut, left, right) or (value,)."""
    best = (1e-6, None)
    gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
    for f in range(len(x[0])) if depth else ():
        a = b = 0.0
        order = sorted(rows, key=lambda i: x[i][f])
        for i, j in zip(order, order[1:], strict=False):
            a, b = a + g[i], b + h[i]
            if x[i][f] == x[j][f]:
                continue
            gain = a * a / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs * gs / (hs + 1)
            if gain > best[0] + 1e-12:
                best = (gain, (f, (x[i][f] + x[j][f]) / 2))
    if best[1] is None:
        return (_leaf(g, h, rows),)
    f, cut = best[1]
    return (f, cut, _grow(x, g, h, [i for i in rows if x[i][f] < cut], depth - 1), _grow(x, g, h, [i for i in rows if x[i][f] >= cut], depth - 1))


def _value(tree: Tree, row: list[float]) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0]


def boost(x: list[list[float]], y: list[int], trees: int = 24, depth: int = 3, rate: float = 0.4) -> list[Tree]:
    """Gradient boosting of the logistic loss."""
    margin, out, rows = [0.0] * len(y), [], list(range(len(y)))
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        tree = _grow(x, [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p], rows, depth)
        out.append(tree)
        margin = [m + rate * _value(tree, r) for m, r in zip(margin, x, strict=True)]
    return out


def calibrate(margin: list[float], y: list[int], rounds: int = 200) -> tuple[float, float]:
    """Platt's scaling of held-out margins: probability = sigmoid(a * margin + b)."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-max(-30, min(30, a * m + b)))) for m in margin]
        a -= 0.1 * sum((q - t) * m for q, t, m in zip(p, y, margin, strict=True)) / len(y)
        b -= 0.1 * sum(q - t for q, t in zip(p, y, strict=True)) / len(y)
    return a, b


class Model:
    """trees, rate, Platt's a and b, and the threshold of each kind; `keep` is the decision as an expression."""

    def __init__(self, trees: list[Tree], rate: float, a: float, b: float, thresholds: dict[int, float]):
        self.trees, self.rate, self.a, self.b, self.thresholds = trees, rate, a, b, thresholds

    def margin(self, row: list[float]) -> float:
        return sum(self.rate * _value(t, row) for t in self.trees)

    def keep(self, c: Column) -> Column:
        def walk(t: Tree) -> Column:
            return F.lit(t[0]) if len(t) == 1 else F.when(F.get(c["f"], t[0]) < t[1], walk(t[2])).otherwise(walk(t[3]))

        total = functools.reduce(lambda p, q: p + q, [walk(t) for t in self.trees]) * self.rate
        p = 1 / (1 + F.exp(-(total * self.a + self.b)))
        least = F.lit(2.0)
        for k, v in self.thresholds.items():
            least = F.when(c["k"] == k, v).otherwise(least)
        return p >= least


@functools.lru_cache(maxsize=1)
def train(spark, precision: float = 0.98) -> Model:
    """Half of the made rows fit the trees, half calibrate them; a kind's threshold is the lowest calibrated
    probability, 0.8 at least, from which on `precision` of the held-out spans are personal data."""
    rows = [r | {"id": i} for i, r in enumerate(examples())]
    made = small_table(spark, rows, "id int, text string, kind int, y int").select("id", "kind", "y", F.explode(candidates(F.col("text"))).alias("c"))
    got = sorted((r[0], r[1], [float(v) for v in r[2]]) for r in made.where("c.k = kind").select("id", "y", "c.f").collect())
    fit, rest = [r for r in got if r[0] % 2 == 0], [r for r in got if r[0] % 2]
    trees, rate = boost([r[2] for r in fit], [r[1] for r in fit]), 0.4
    model = Model(trees, rate, 1.0, 0.0, {})
    margins = [model.margin(r[2]) for r in rest]
    model.a, model.b = calibrate(margins, [r[1] for r in rest])
    for k in range(len(KINDS)):
        own = sorted(((1 / (1 + math.exp(-(model.a * m + model.b))), r[1]) for m, r in zip(margins, rest, strict=True) if r[2][0] == k), reverse=True)
        good = 0
        for n, (p, y) in enumerate(own, 1):
            good += y
            if p >= 0.8 and good >= precision * n:
                model.thresholds[k] = p
    return model


def find(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """Adds base and spans, array<struct a, k, b> in order: offsets in code points (end exclusive), k into KINDS.

    spans holds base and what the model adds. Null and empty texts have empty arrays. Each row is searched by itself
    and whole, so no row moves between tasks and repeated rows agree; columns of these two names are replaced. Work is in
    proportion to a text's length and spans. Empty input, empty output.
    """
    model = model or train(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    base, wide, text_ = unused(docs, "_base", "_wide", "_text")
    none = F.array().cast(f"array<{SPAN}>")
    value = F.coalesce(col(text), F.lit(""))
    some = value.rlike(r"[0-9]|@|(?i:\Wat\W)")
    out = docs.select(*[col(c) for c in kept], value.alias(text_))
    out = out.withColumn(base, F.when(some, base_spans(F.col(text_))).otherwise(none))
    kept_wide = F.filter(candidates(F.col(text_)), model.keep)
    out = out.withColumn(wide, F.when(some, F.transform(kept_wide, lambda s: F.struct(s["a"].alias("a"), s["k"].alias("k"), s["b"].alias("b")))).otherwise(F.array().cast("array<struct<a:int,k:int,b:int>>")))
    thin = F.transform(base, lambda s: F.struct(s["a"].alias("a"), s["k"].alias("k"), s["b"].alias("b")))
    # as text, equal spans are found by hashing
    code = lambda s: F.concat_ws(":", s["a"], s["k"], s["b"])
    more = F.array_except(F.transform(wide, code), F.transform(thin, code))
    part = lambda c, i: F.get(F.split(c, ":"), i).cast("int")
    more = F.transform(more, lambda c: F.struct(part(c, 0).alias("a"), part(c, 1).alias("k"), part(c, 2).alias("b")))
    return out.select(*[col(c) for c in kept], thin.alias("base"), F.when(F.size(wide) > 0, F.array_sort(F.concat(thin, more))).otherwise(thin).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["a"], s["b"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mark in brackets for each run of spans that overlap. It is cut by pieces, so that a place is found
    without counting from its beginning."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column):
        kept = F.struct(acc["reach"].alias("x"), s["a"].alias("y"), (s["a"] >= acc["reach"]).alias("fresh"), s["k"].alias("k"))
        return {"reach": F.greatest(acc["reach"], s["b"])}, kept

    def put(pieces: Column) -> Column:
        def between(x: Column, y: Column) -> Column:
            """The code points from x to y."""
            i, j = F.floor(x / PIECE).cast("int"), F.floor((y - 1) / PIECE).cast("int")
            first, last = F.get(pieces, i), F.get(pieces, j)
            near = F.substr(first, x % PIECE + 1, y - x)
            far = F.concat(F.substr(first, x % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.substr(last, F.lit(1), (y - 1) % PIECE + 1))
            return F.when(y <= x, "").when(i == j, near).otherwise(far)

        parts = running(spans, {"reach": F.lit(0)}, step, "struct<x:int,y:int,fresh:boolean,k:int>")
        shown = F.transform(F.filter(parts, lambda p: p["fresh"]), lambda p: F.concat(between(p["x"], p["y"]), F.get(marks, p["k"])))
        end = F.array_max(F.transform(spans, lambda s: s["b"]))
        return F.concat(F.array_join(shown, ""), between(end, F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))
    return F.when(F.size(spans) > 0, bound(pieces, put)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs with each found span of `text` replaced by its kind in brackets; spans that overlap become one, named by
    the first. Null texts stay null, and texts without spans stay as they are. Repeated rows agree."""
    names = docs.columns
    spans, base = unused(docs, "_spans", "_base0")
    inner = [f"c{i}_" for i in range(len(names))]
    t = f"c{names.index(text)}_"
    out = find(docs.toDF(*inner), t, model).withColumnsRenamed({"spans": spans, "base": base})
    return out.select(*[(redacted(F.col(t), F.col(spans)) if n == text else F.col(i)).alias(n) for n, i in zip(names, inner, strict=True)])


def op7(docs: DataFrame) -> DataFrame:
    out = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *[count(k) for k in range(4)], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """redact() with n_chars, where there is such a column, set to the length of texts that changed."""
    names = docs.columns
    if "n_chars" not in names:
        return redact(docs)
    (was,) = unused(docs, "_was")
    out = redact(docs.withColumn(was, F.col("text")))
    changed = F.when(~F.col("text").eqNullSafe(F.col(was)), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*[col(c) for c in names])
