"""Personal data: base patterns, and further spans chosen by boosted trees, all in expressions.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches per kind that pass their
checks.  On top of them high-recall generators propose overlapping candidates (local phone and
international numbers, national ids, bank accounts, spelled-out addresses, keys and tokens).
Boosted trees score each from its format and context and a threshold per kind, calibrated on
examples that the trees did not see, selects.  International numbers are candidates too: their base
pattern runs on into digits that follow, and then fails its check.  The trees are fitted in numpy
on a few thousand generated sentences, whose features the same Spark expressions compute, and become
nested conditional expressions.  A sentence's label says what was generated; its cues are drawn from
more words than the features know, some are missing and some mislead.  Candidates that overlap a
base span or a better candidate are dropped; base spans always stay.

Time is near linear in the text and its matches.  Possessive patterns and look-behinds try a run of
characters once, from its start; places are sums over blocks of matches; text is cut from pieces;
and a candidate is compared with its neighbours in order, as no more than that can overlap it.

Defined results: null text counts as empty and has no spans; repeated rows give repeated results;
of candidates that tie the one that starts first and then the kind listed first is better; an empty
table gives no rows.  Only ``doc_id`` and ``text`` are read by the query, and only what is asked to
be kept by ``redact``, so other columns may have any names but those that begin with ``__``.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import built_fast, once, table

BASE = ("email", "ip", "card", "phone")
MORE = ("tel", "natid", "iban", "mail", "intl", "secret")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "tel": r"(?<![0-9(+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "natid": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mail": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,40}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{2,40}\x20?[\[(]\x20?dot\x20?[\])]\x20?[a-z]{2,10}(?![a-z0-9])",
    "intl": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+=*+",
}
#: A text without this holds no match, and the pattern is not tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "tel": None, "natid": "-", "iban": None, "mail": None, "intl": "+", "secret": None}
#: Characters that are read on either side of a candidate; cues farther off count as FAR away.
CONTEXT, FAR = 80, 200
CALL = r"phone|telephone|tel|call|calls|calling|fax|mobile|cell|dial|ring|text|contact|reach|whatsapp"
HINTS = {
    "tel": CALL, "intl": CALL, "natid": r"ssn|ssns|social[\x20-]security|national\x20(?:id|identity|insurance)|tax(?:payer)?\x20id",
    "iban": r"iban|account|bank|transfer|wire|pay|payment", "mail": r"contact|reach|write|mail|email|e-mail|address",
    "secret": r"token|key|apikey|api_key|access_key|secret|password|passwd|pwd|auth|bearer|credential|credentials",
}
AGAINST = r"version|isbn|order|part|serial|invoice|ticket|build|model|code|ref|item|commit|checksum|hash|file|page"
#: Ends of addresses that count as a check of a spelled-out one.
ENDS = r"(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us)"
FEATURES = ("kind", "length", "digits", "separators", "hint_before", "hint_after", "against_before", "against_after", "lead", "checks")
SPAN = "array<struct<start:int,stop:int,value:string>>"


#: Steps of a sum over blocks, candidates on either side that may overlap one, characters of a piece.
STEP, BESIDE, PIECE = 64, 64, 1024

# The functions from here to ``digits_of`` make SQL text of SQL text: large expressions are parsed
# at once, where building them call by call would take longer than running them.


def bound(value: str, name: str, use: str) -> str:
    """``use`` with ``name`` standing for the value, evaluated once: the variable of a lambda."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def running(values: str, start: str, add) -> str:
    """For each of some values what ``add`` makes of those before it, by way of blocks of them."""
    total = lambda xs: f"aggregate({xs}, {start}, (a, b) -> {add('a', 'b')})"
    blocks = f"transform(filter(sequence(0, cast(ceil(size({values}) / {STEP}) as int)), n -> n * {STEP} < size({values})), k -> {total(f'slice({values}, k * {STEP} + 1, {STEP})')})"
    before = bound(blocks, "sums", f"transform(sums, (e, k) -> {total('slice(sums, 1, k)')})")
    inside = total(f"slice({values}, i - i % {STEP} + 1, i % {STEP})")
    return bound(before, "sums", f"transform({values}, (e, i) -> {add(f'get(sums, cast(i div {STEP} as int))', inside)})")


def plus(a: str, b: str) -> str:
    return f"{a} + {b}"


def larger(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def part(start: str, size: str) -> str:
    """``size`` characters of the text from ``start`` on, from the pieces ``__cut``."""
    first = f"cast(({start}) div {PIECE} as int)"
    return f"substring(array_join(slice(__cut, {first} + 1, cast((({start}) + greatest({size}, 0)) div {PIECE} as int) - {first} + 1), ''), ({start}) % {PIECE} + 1, {size})"


def clear_of(spans: str, base: str) -> str:
    """Spans that overlap none of the base spans, whatever the length of those."""
    both = f"sort_array(concat(transform({base}, b -> struct(b.start as start, b.stop as stop, -1 as number)), transform({spans}, (c, i) -> struct(c.start as start, c.stop as stop, i as number))))"
    reach = bound("transform(xs, x -> if(x.number < 0, x.stop, -1))", "stops", running("stops", "-1", larger))
    ahead = f"exists(slice(xs, i + 2, {BESIDE}), y -> y.number < 0 and y.start < x.stop)"
    clear = f"filter(transform(xs, (x, i) -> if(x.number >= 0 and get(before, i) <= x.start and not {ahead}, x.number, null)), n -> n is not null)"
    kept = bound(both, "xs", bound(reach, "before", f"transform({clear}, n -> get({spans}, n))"))
    return f"if(size({spans}) > 0 and size({base}) > 0, {kept}, {spans})"


def best_of(scored: str) -> str:
    """Of sorted (start, stop, loss, rank, kind) those that no better one overlaps, twice over.

    Matches of a kind do not overlap, have 9 characters or more, and all but keys at most some 130,
    so ``BESIDE`` neighbours in order hold all that can overlap a span from one side; a longer key
    meets those that begin in it.
    """

    def tops(xs: str) -> str:
        worse = "x.start < y.stop and y.start < x.stop and struct(y.loss as l, y.start as s, y.rank as r) < struct(x.loss as l, x.start as s, x.rank as r)"
        return f"filter({xs}, (x, i) -> not exists(slice({xs}, greatest(i - {BESIDE}, 0) + 1, {2 * BESIDE + 1}), y -> {worse}))"

    rest = bound(clear_of(scored, "top"), "more", tops("more"))
    return f"if(size({scored}) > 1, {bound(tops(scored), 'top', f'sort_array(concat(top, {rest}))')}, {scored})"


def matches(frame: DataFrame, kinds: tuple[str, ...], when: Column) -> DataFrame:
    """Adds ``__found``: of each kind the matches as (start, stop, value), in code points.

    A split gives what is between the matches.
    """
    text = F.col("__text")

    def lists(k: str) -> Column:
        worth = when & F.contains(text, F.lit(NEEDS[k])) if NEEDS[k] else when
        return F.when(worth, F.struct(F.split(text, PATTERNS[k], -1).alias("parts"), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)).alias("values")))

    def each(make) -> Column:
        return once(F.expr(f"struct({', '.join(f'{make(k)} as {k}' for k in kinds)})"))

    listed = frame.withColumn("__lists", once(F.struct(*[lists(k).alias(k) for k in kinds])))
    sized = listed.withColumn("__sizes", each(lambda k: f"if(size(__lists.{k}.values) > 0, transform(__lists.{k}.values, (v, i) -> length(get(__lists.{k}.parts, i)) + length(v)), null)"))
    placed = sized.withColumn("__before", each(lambda k: f"if(__sizes.{k} is not null, {running(f'__sizes.{k}', '0', plus)}, null)"))
    begin = lambda k: f"get(__before.{k}, i) + length(get(__lists.{k}.parts, i))"
    spans = lambda k: f"coalesce(transform(__lists.{k}.values, (v, i) -> struct({begin(k)} as start, {begin(k)} + length(v) as stop, v as value)), cast(array() as {SPAN}))"
    return placed.withColumn("__found", each(spans)).drop("__lists", "__sizes", "__before")


PIECES = f"transform(sequence(0, cast(length(__text) div {PIECE} as int)), k -> substring(__text, k * {PIECE} + 1, {PIECE}))"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


#: True if the letters and digits of an account number ``s.value`` have remainder 1.
MOD97 = bound(
    "replace(s.value, ' ', '')", "plain",
    bound("concat(substring(plain, 5), substring(plain, 1, 4))", "t", "aggregate(transform(sequence(1, length(t)), i -> ascii(substring(t, i, 1))), 0, (r, c) -> if(c < 58, (r * 10 + c - 48) % 97, (r * 100 + c - 55) % 97)) = 1"),
)


def passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\.", -1), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(digits_of(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(value))).otherwise(False)
    return n.between(10, 15)


@built_fast
def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``__text``, ``__digit`` and ``__base``: (start, rank of the kind, stop, kind), sorted."""
    text = F.col("__text")
    plain = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    marked = plain.withColumn("__digit", once(text.rlike("[0-9]")))

    def of(rank: int, kind: str) -> Column:
        good = F.filter(F.col("__found")[kind], lambda s: passes(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    kinds = [of(rank, kind) for rank, kind in enumerate(BASE)]
    return matches(marked, BASE, F.col("__digit") | F.contains(text, F.lit("@"))).withColumn("__base", once(F.sort_array(F.concat(*kinds)))).drop("__found")


@built_fast
def candidates(frame: DataFrame) -> DataFrame:
    """Adds ``__more``: candidates clear of base spans, with their features."""
    raw = matches(frame, MORE, F.col("__digit") | F.col("__text").rlike("(?i)dot"))

    def each(make) -> Column:
        return once(F.expr(f"struct({', '.join(f'{make(number, k)} as {k}' for number, k in enumerate(MORE))})"))

    # Spans that overlap base ones go before anything is read of them.
    clear = raw.withColumn("__clear", each(lambda _, k: clear_of(f"__found.{k}", "__base")))
    cut = clear.withColumn("__cut", once(F.expr(f"if({' or '.join(f'size(__clear.{k}) > 0' for k in MORE)}, {PIECES}, null)")))
    # A word that the context cuts is none: one character more is read, and goes with its word.
    before, after = part(f"greatest(s.start - {CONTEXT + 1}, 0)", f"least(s.start, {CONTEXT + 1})"), part("s.stop", str(CONTEXT + 1))
    whole = f"struct(s as s, if(s.start > {CONTEXT}, regexp_replace(n.before, r'^\\w+', ''), n.before) as before, if(length(n.after) > {CONTEXT}, regexp_replace(n.after, r'\\w+$', ''), n.after) as after)"
    near = cut.withColumn("__around", each(lambda _, k: f"transform(__clear.{k}, s -> {bound(f'struct({before} as before, {after} as after)', 'n', whole)})")).drop("__found", "__clear", "__cut")

    def away(context: str, words: str, which: int) -> str:
        return bound(rf"split({context}, r'(?i)\b(?:{words})\b', -1)", "p", f"if(size(p) > 1, double(length(element_at(p, {which}))), double({FAR}))")

    def features(number: int, kind: str) -> str:
        checks = {"iban": MOD97, "mail": f"rlike(s.value, r'(?i)[^a-z]{ENDS}$')"}.get(kind, "false")
        values = {
            "kind": f"double({number})", "length": "double(length(s.value))", "digits": "double(length(regexp_replace(s.value, '[^0-9]', '')))", "separators": "double(length(regexp_replace(s.value, '[A-Za-z0-9]', '')))", "hint_before": away("a.before", HINTS[kind], -1), "hint_after": away("a.after", HINTS[kind], 1),
            "against_before": away("a.before", AGAINST, -1), "against_after": away("a.after", AGAINST, 1), "checks": f"if({checks}, double(1), double(0))",
        }
        found = f"struct(s.start as start, {len(BASE) + number} as rank, s.stop as stop, '{kind}' as kind_name, {', '.join(f'{v} as {c}' for c, v in values.items())})"
        chosen = ", ".join("f.against_before - f.hint_before as lead" if c == "lead" else f"f.{c} as {c}" for c in ("start", "rank", "stop", "kind_name", *FEATURES))
        return f"transform(__around.{kind}, a -> {bound('a.s', 's', bound(found, 'f', f'struct({chosen})'))})"

    described = ", ".join(features(number, k) for number, k in enumerate(MORE))
    return near.withColumn("__more", once(F.expr(f"concat({described})"))).drop("__around")


# --- boosted trees -----------------------------------------------------------------------------


class Boosted:
    """Depth-three regression trees on the logistic loss, small enough to be expressions."""

    def __init__(self, trees: dict[str, list], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
        best, at = 1e-6, None
        total = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - total
                if gain > best:
                    best, at = gain, (f, float(cut))
        return at

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.3, seed: int = 5) -> Boosted:
        """Trees for each kind; three tenths of the examples are kept for the thresholds."""
        part = np.random.default_rng(seed).random(len(x)) < 0.7
        model = cls({}, {})

        def node(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
            at = cls._split(x, g, h) if depth else None
            if at is None:
                return float(rate * g.sum() / (h.sum() + 1))
            left = x[:, at[0]] <= at[1]
            return (*at, node(x[left], g[left], h[left], depth - 1), node(x[~left], g[~left], h[~left], depth - 1))

        for number, kind in enumerate(MORE):
            of = x[:, 0] == number
            tx, ty, trees = x[of & part], y[of & part], []
            score = np.zeros(len(tx))
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-score))
                trees.append(node(tx, ty - p, p * (1 - p), 3))
                score += cls._predict(trees[-1], tx)
            model.trees[kind] = trees
            model.thresholds[kind] = cls._calibrate(model._sum(kind, x[of & ~part]), y[of & ~part])
        return model

    @staticmethod
    def _calibrate(score: np.ndarray, y: np.ndarray, precision: float = 0.9) -> float:
        """The lowest threshold at which unseen examples are so precise; infinite if there is none."""
        for cut in np.unique(score):
            if y[score >= cut].mean() >= precision:
                return float(cut) - 1e-9
        return float("inf")

    @staticmethod
    def _predict(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, Boosted._predict(low, x), Boosted._predict(high, x))

    def _sum(self, kind: str, x: np.ndarray) -> np.ndarray:
        return sum((self._predict(t, x) for t in self.trees[kind]), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for number, kind in enumerate(MORE):
            out[x[:, 0] == number] = self._sum(kind, x[x[:, 0] == number])
        return out

    def sql(self) -> str:
        """The score of a candidate ``c``."""

        def of(tree) -> str:
            if not isinstance(tree, tuple):
                return f"double({tree!r})"
            f, cut, low, high = tree
            return f"if(c.{FEATURES[f]} <= double({cut!r}), {of(low)}, {of(high)})"

        sums = [" + ".join(map(of, self.trees[k])) for k in MORE]
        return f"case {' '.join(f'when c.kind = {number} then {total}' for number, total in enumerate(sums))} end"

    def cut_sql(self) -> str:
        known = [(number, self.thresholds[k]) for number, k in enumerate(MORE) if np.isfinite(self.thresholds[k])]
        return f"case {' '.join(f'when c.kind = {number} then double({cut!r})' for number, cut in known)} else double('infinity') end" if known else "double('infinity')"


#: Lead-ins of what is personal and of what only looks like it, and words that say nothing.  Some
#: are no cues of the features, and some of the second sort are cues of the first.
LEADS = {
    "tel": ("call me at", "phone:", "reach our office on", "my number is", "you get me under", "tel.", "fax", "hotline", "text her at", "ring", "number of the desk:", "mobile"),
    "natid": ("SSN", "social security number", "national id", "his tax id is", "insured under", "personal number", "social security", "her number is"),
    "iban": ("IBAN", "bank account", "transfer to", "pay into", "account", "please credit"),
    "mail": ("contact", "write to", "reach me:", "mail", "send it to", "ask"),
    "intl": ("call", "phone", "reach us under", "fax", "ring", "whatsapp", "number"),
    "secret": ("token =", "api_key:", "secret", "password", "bearer", "access key", "set this to", "key", "auth", "login with"),
}
LOOKS = {
    "tel": ("order", "part number", "version", "serial", "invoice", "tracking", "batch", "lot", "case", "phone model", "call number", "pages"),
    "natid": ("part", "order", "catalogue", "batch", "flight", "code", "item", "social club, ticket", "ref", "scores"),
    "iban": ("part", "article", "serial", "account of item", "order", "model"),
    "mail": ("look", "we met", "they start", "write it", "the path is", "seen"),
    "intl": ("a gain of", "version", "part", "serial", "scores", "offset", "the sum of", "call option", "balance"),
    "secret": ("commit", "checksum", "file", "page", "see", "the key idea of", "item", "hash", "folder", "build"),
}
IDLE = "the house river was seen and then early number is of our office at under for no. desk on last year 2019".split()


def examples(seed: int = 11, n: int = 6000) -> list[tuple[int, str, str]]:
    """(label, sentence, kind): generated sentences with one candidate each."""
    draw = np.random.default_rng(seed)
    pick = lambda *x: x[draw.integers(len(x))]
    number = lambda k: "".join(map(str, draw.integers(0, 10, k)))
    chars = lambda alphabet, k: "".join(alphabet[i] for i in draw.integers(0, len(alphabet), k))
    words = lambda low, high: " ".join(pick(*IDLE) for _ in range(draw.integers(low, high)))
    out = []
    for i in range(n):
        kind, label = MORE[i % len(MORE)], int(draw.random() < 0.5)
        if kind == "tel":
            sep = pick("-", ".", " ") if label else pick("-", " ", " ", ".")
            bare = f"{number(3)}{sep}{number(3)}{sep}{number(4)}"
            value = pick(f"({number(3)}) {number(3)}-{number(4)}", bare) if label else pick(*[bare] * 6, f"({number(3)}) {number(3)}-{number(4)}")
        elif kind == "natid":
            value = f"{number(3)}-{number(2)}-{number(4)}"
        elif kind == "iban":
            country, account = pick("DE", "FR", "ES"), number(18)
            rest = int(account + "".join(str(ord(c) - 55) for c in country) + "00") % 97
            value = f"{country}{98 - rest if label else (98 - rest + draw.integers(1, 90)) % 97:02d}{account}"
        elif kind == "intl":
            value = pick(f"+1 ({number(3)}) {number(3)}-{number(4)}", f"+{number(2)} {number(3)} {number(3)} {number(4)}", f"+1-{number(3)}-{number(3)}-{number(4)}") if label else pick(f"+{number(2)} {number(3)} {number(3)} {number(3)}", f"+{number(3)} {number(3)} {number(4)}", f"+{number(2)} {number(3)} {number(3)} {number(4)}")
            value += pick(" 10.2", " 7", " 2024-05") if label else pick(" 500 300", " 7 9", " 2024-05")
        elif kind == "mail":
            end = pick("org", "com", "net", "de", "dev") if label else pick("then", "product", "end", "side", "line")
            value = f"{pick('ana', 'joe.smith', 'max_1', 'look', 'x')} [at] {pick('mail', 'example', 'noon', 'this')} [dot] {end}"
        elif label:
            value = pick(chars("0123456789abcdef", pick(32, 40, 64)), chars("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789", pick(20, 24, 36, 40)))
        else:
            name = pick("-", "_", "/").join([pick(*IDLE).strip(".") for _ in range(draw.integers(4, 8))] + [number(pick(1, 2, 4))])
            value = pick(*[name + "-appendix-of-it"] * 3, chars("0123456789abcdef", pick(32, 40, 64)))
        lead, other = (pick(*(LEADS if label else LOOKS)[kind]), pick(*(LOOKS if label else LEADS)[kind]))
        if draw.random() < 0.02:
            lead = other
        quote = pick("", "", '"') if kind == "secret" else ""
        shape = draw.random() if label or kind != "intl" else draw.uniform(0.4, 1)
        if shape < (0.4 if kind in ("intl", "mail") else 0.1):
            around = f"{quote}{value}{quote}"
        elif shape < 0.35:
            around = f"{lead}{pick('', ':', ' #')} {quote}{value}{quote}"
        elif shape < 0.6:
            around = f"{lead} {words(1, 7)}{pick('', ':')} {quote}{value}{quote}"
        elif shape < 0.8 and kind != "intl":
            around = f"{quote}{value}{quote} {pick('is', 'is my', 'is the', '(', '-')} {lead}"
        else:
            around = f"{other} {words(6, 12)} {lead} {words(0, 4)} {quote}{value}{quote}"
        if 0.1 <= shape < 0.6 and draw.random() < 0.3:
            around += f"{pick(',', ' now,', '.')} {other}"
        out.append((label, f"{words(6, 12)} {around} {words(6, 12)}", kind))
    return out


def described(spark: SparkSession, rows: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of generated sentences: a bounded number, read by the driver."""
    frame = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(rows)], "doc_id long, text string").coalesce(1)
    x, y = [], []
    for r in candidates(base_spans(frame, ["doc_id"])).select("doc_id", "__more").collect():
        for c in r["__more"]:
            if c.kind_name == rows[r.doc_id][2]:
                x.append([c[f] for f in FEATURES])
                y.append(rows[r.doc_id][0])
    return np.array(x), np.array(y, float)


@functools.lru_cache(maxsize=1)
def trained(spark: SparkSession) -> Boosted:
    return Boosted.fit(*described(spark, examples()))


def held_out(spark: SparkSession, seed: int = 12) -> dict[str, tuple[float, float]]:
    """Precision and recall by kind on other generated sentences."""
    model, (x, y) = trained(spark), described(spark, examples(seed))
    out, score = {}, model.score(x)
    for number, kind in enumerate(MORE):
        of = x[:, 0] == number
        chosen = score[of] >= model.thresholds[kind]
        out[kind] = (float(y[of][chosen].mean()) if chosen.any() else 1.0, float(chosen[y[of] == 1].mean()))
    return out


@built_fast
def detect(docs: DataFrame, keep: list[str], model: Boosted) -> DataFrame:
    """Adds ``__text``, ``__base`` and ``__spans``: base and chosen spans, in order."""
    frame = candidates(base_spans(docs, keep))
    judged = f"transform(__more, c -> struct(c.start as start, c.stop as stop, -({model.sql()}) as loss, c.rank as rank, c.kind_name as kind, {model.cut_sql()} as cut))"
    scored = frame.withColumn("__scored", once(F.expr(f"sort_array(filter({judged}, c -> -c.loss >= c.cut))"))).drop("__more")
    # Best first: a candidate that overlaps a better one goes.
    chosen = scored.withColumn("__best", once(F.expr(best_of("__scored")))).drop("__scored")
    every = "sort_array(concat(__base, transform(__best, c -> struct(c.start as start, c.rank as rank, c.stop as stop, c.kind as kind))))"
    return chosen.withColumn("__spans", once(F.expr(f"if(size(__best) > 0, {every}, __base)"))).drop("__best")


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


@built_fast
def report(docs: DataFrame, model: Boosted) -> DataFrame:
    of = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    return detect(docs, ["doc_id"], model).select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(written("__base"), 256).alias("base_sha256"), written("__spans").alias("spans"))


@built_fast
def redact(docs: DataFrame, keep: list[str], model: Boosted) -> DataFrame:
    """The columns ``keep`` and ``text`` with every span replaced by its kind in brackets.

    Of spans that overlap the first is named, and all their characters go.
    """
    some = detect(docs.select(*keep, "text"), keep, model)
    # Of each span where those before it end.
    ends = bound("transform(__spans, s -> s.stop)", "stops", running("stops", "0", larger))
    cut = some.withColumn("__cut", once(F.expr(f"if(size(__spans) > 0, {PIECES}, null)"))).withColumn("__ends", once(F.expr(f"if(size(__spans) > 0, {ends}, null)")))
    between = part("get(__ends, i)", "s.start - get(__ends, i)")
    gaps = f"array_join(transform(__spans, (s, i) -> if(s.start >= get(__ends, i), concat({between}, '[', upper(s.kind), ']'), '')), '')"
    rest = bound("greatest(element_at(__ends, -1), element_at(__spans, -1).stop)", "last", part("last", "length(__text) - last"))
    return cut.select(*keep, once(F.expr(f"if(size(__spans) > 0, concat({gaps}, {rest}), __text)")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), trained(spark))
