"""Personal data: candidate spans, boosted trees, calibrated thresholds, in DataFrame and SQL functions only.

Four exact kinds (email, ip, card, phone) are always found.  High-recall generators propose further,
overlapping spans: loose e-mail addresses and phone numbers, values set to names such as "password",
and long keys.  Boosted trees over a candidate's format and context give its probability, each kind
has its own threshold, and what passes and overlaps nothing found before is added.

There are no labels for personal data in a corpus, so the trees are trained on texts that are made by
SQL from stated templates, personal ones and harmless look-alikes (versions, dates, counts, hashes in
prose).  One family of templates fits the trees; on another family, of other shapes, each kind's threshold is the
lowest at which at least ``PRECISION`` of what passes is personal.  The fitted trees become one SQL expression,
so documents are read once, without shuffle, and spans never leave their row.

Offsets are in code points, ends exclusive.  Patterns that start with a run are guarded so that a
search starts only at the run's start (or where the last match ended), which keeps long runs linear
and finds the same leftmost matches.  A long text is searched in pieces of about ``PIECE_CHARS`` characters, cut after
a comma, a semicolon, white space other than a space or three spaces, or at a space between a letter and a letter or
digit: no pattern crosses such a place or looks across it, so the matches are those of the whole text.  A
candidate's context ends at its piece, or at the same generator's match before.  In a piece, lists are
walked in stretches, so that time stays near to linear where a text has no such place.

Edge cases: null text is empty and has no spans; texts of any length are searched whole; repeated rows
each give their spans; an empty table gives no rows; other columns are ignored (and kept by ``redact``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkyard.llm.common import free_name

KINDS = ("email", "ip", "card", "phone", "secret")
#: In the form in which a search visits a run once; repeated groups are possessive, which takes no stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

NAMED = r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?[^\s\"',;]{6,}"
KEY = r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?<![A-Za-z0-9+.-])(?:\(?[0-9]{1,5}\)?(?:[\x20.-]\(?[0-9]{2,6}\)?){1,4}|[0-9]{7,12})(?![A-Za-z0-9-])"
#: Characters of a piece before the place is looked for where it ends.
PIECE_CHARS = 2048
PIECE = rf"[\s\S]{{{PIECE_CHARS}}}[\s\S]*?(?:[\t\n\x0B\f\r,;]|\x20{{3}}|(?<=[A-Za-z])\x20(?=[A-Za-z0-9])|(?<=[0-9])\x20(?=[A-Za-z]))|[\s\S]+"
#: Elements of a list that are walked together, and characters of a block that is cut from.
STRETCH = 128
BLOCK_CHARS = 512

PRECISION = 0.99
#: Texts made to train on and to calibrate with; the only training data.
MADE_TEXTS = 4000
CONTEXT_CHARS = 24

FEATURES = ("generator", "length", "digits", "capitals", "others", "letters", "kinds_of_chars", "switches", "has_at", "has_sign", "named", "context_person", "context_number")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def stretches(xs: Column) -> Column:
    """The list in lists of STRETCH elements."""
    at = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(STRETCH)), lambda k: F.slice(xs, k, STRETCH))
    return F.when(F.size(xs) > STRETCH, at).when(F.size(xs) > 0, F.array(xs)).otherwise(F.slice(F.array(xs), 1, 0))


def walked(xs: Column, state: Column, step: Callable[[Column, Column, Column], tuple[Column, Column]], end: Callable[[Column], Column] | None = None) -> Column:
    """A list from a fold: ``step`` gives of the state, the list so far and an element the next state and list; ``end``
    of the last state what comes after the list.  Lists grow within a stretch only."""
    out = F.slice(F.array(end(state) if end else xs[0]), 1, 0) if end else F.slice(xs, 1, 0)
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def stretch(acc: Column, ys: Column) -> Column:
        inner = F.aggregate(ys, pair(acc["state"], out), lambda a, y: pair(*step(a["state"], a["out"], y)))
        return let(inner, lambda r: pair(r["state"], F.concat(acc["out"], r["out"])))

    last = (lambda acc: F.concat(acc["out"], F.array(end(acc["state"])))) if end else (lambda acc: acc["out"])
    return F.aggregate(stretches(xs), pair(state, out), stretch, last)


def before(lengths: Column) -> Column:
    """The sum of what stands before each element: within its stretch, after the stretches before."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def summed(parts: Column) -> Column:
        sums = F.transform(parts, total)
        return let(sums, lambda s: F.flatten(F.transform(parts, lambda xs, k: let(total(F.slice(s, 1, k)), lambda base: F.transform(xs, lambda _, j: base + total(F.slice(xs, 1, j)))))))

    return let(stretches(lengths), summed)


_FOUND = "array<struct<start:int,end:int,what:string,lead:string>>"


def found(text: Column, pattern: str) -> Column:
    """All matches, leftmost first: array of start, end, what and lead (some of what stands between it and the match before)."""

    def placed(matched: Column, gaps: Column) -> Column:
        starts = F.zip_with(before(F.zip_with(gaps, matched, lambda g, m: F.length(g) + F.length(m))), gaps, lambda a, g: a + F.length(g))
        ends = F.zip_with(starts, matched, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("what")))
        return F.zip_with(ends, gaps, lambda x, g: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["what"].alias("what"), F.right(g, F.lit(CONTEXT_CHARS)).alias("lead")))

    gaps = lambda m: F.slice(F.split(text, pattern, -1), 1, F.size(m))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, F.array().cast(_FOUND)).otherwise(let(gaps(m), lambda g: placed(m, g))))


def pieces(text: Column) -> Column:
    """The text in pieces that are searched each by itself: array of at and text."""
    cut = lambda ps: F.zip_with(before(F.transform(ps, lambda p: F.length(p))), ps, lambda a, p: F.struct(a.alias("at"), p.alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("at"), text.alias("text")))
    return F.when(F.length(text) <= PIECE_CHARS, whole).otherwise(let(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), cut))


def moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["what"].alias("what")))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["what"].alias("what"), s["lead"].alias("lead")))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["what"].alias("what")))


def _digits(what: Column) -> Column:
    return F.regexp_replace(what, "[^0-9]", "")


_SPANS = "array<struct<start:int,kind:int,end:int,what:string,lead:string>>"


def base_spans(text: Column) -> Column:
    """The four exact kinds in a piece: array of start, kind, end, what, by start and then kind."""
    none = F.array().cast(_SPANS)
    octet = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255)
    email = F.when(F.contains(text, F.lit("@")), _of_kind(found(text, EMAIL), "email")).otherwise(none)
    ip = _of_kind(F.filter(found(text, IP), lambda s: F.forall(F.split(s["what"], r"\.", -1), octet)), "ip")
    card = _of_kind(F.filter(found(text, CARD), lambda s: F.length(_digits(s["what"])).between(12, 19) & F.call_function("luhn_check", _digits(s["what"]))), "card")
    phone = F.when(F.contains(text, F.lit("+")), _of_kind(F.filter(found(text, PHONE), lambda s: F.length(_digits(s["what"])).between(9, 15)), "phone")).otherwise(none)
    return F.array_sort(_plain(F.concat(email, ip, card, phone)))


_CANDIDATES = [(LOOSE_EMAIL, "email"), (LOOSE_PHONE, "phone"), (NAMED, "secret"), (KEY, "secret")]


def candidates(text: Column) -> Column:
    """What the generators propose, with features: array of start, kind, end, what and one field for each feature."""
    parts = []
    for number, (pattern, kind) in enumerate(_CANDIDATES):
        spans = _of_kind(found(text, pattern), kind)
        if pattern is KEY:  # a key has a digit, or a known form; long words are not proposed
            spans = F.filter(spans, lambda s: s["what"].rlike("[0-9]|^A[KS]IA[A-Z]{16}$"))
        if pattern is LOOSE_EMAIL:
            spans = F.when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")), spans).otherwise(F.array().cast(_SPANS))
        parts.append(F.transform(spans, _featuring(number)))
    return F.concat(*parts)


def _featuring(number: int) -> Callable[[Column], Column]:
    """From a span to the span with its features."""
    return lambda s: _featured(s, number)


def _featured(s: Column, number: int) -> Column:
    what = s["what"]
    count = lambda pattern: F.length(F.regexp_replace(what, pattern, "")).cast("double")
    lead = F.lower(s["lead"])
    value = {
        "generator": F.lit(float(number)),
        "length": F.length(what).cast("double"),
        "digits": count("[^0-9]"),
        "capitals": count("[^A-Z]"),
        "others": count("[A-Za-z0-9]"),
        "letters": count("[^a-z]"),
        "kinds_of_chars": F.size(F.array_distinct(F.split(what, ""))).cast("double"),
        "switches": F.size(F.regexp_extract_all(what, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0))).cast("double"),
        "has_at": F.contains(what, F.lit("@")).cast("double"),
        "has_sign": what.rlike(r"[()=:\[\]]").cast("double"),
        "named": F.lower(what).rlike("^(password|passwd|pwd|secret|token|api|access)").cast("double"),
        "context_person": lead.rlike(r"(phone|call|tel|mobile|fax|mail|contact|reach)").cast("double"),
        "context_number": lead.rlike(r"(version|release|order|item|page|isbn|date|build|commit|ticket|no\.|#)").cast("double"),
    }
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), what.alias("what"), *[value[f].alias(f) for f in FEATURES])


def made_texts(spark: SparkSession, count: int = MADE_TEXTS) -> DataFrame:
    """Texts with one candidate each: id, text, label (1: personal), family (0 to fit, 1 to calibrate; their templates differ)."""
    seed = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 40))
    digits = lambda salt, n: F.lpad((F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n))).cast("string"), n, "0")
    hexes = lambda salt, n: F.substring(F.sha2(F.concat("id", F.lit(salt)), 256), 1, n)
    mixed = lambda salt, n: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat("id", F.lit(salt)), 256))), "+/=", "xY7"), 1, n)
    capitals = lambda salt: F.substring(F.translate(F.upper(F.base64(F.unhex(F.sha2(F.concat("id", F.lit(salt)), 256)))), "+/=1089", "ABCDEFG"), 1, 16)
    pick = lambda salt, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (seed(salt) % len(xs) + 1).cast("int"))
    word = lambda salt: pick(salt, "anna", "max", "river", "stone", "paper", "window", "garden", "letter", "market", "orders", "north", "bright")
    c = F.concat
    lit = F.lit
    host = c(word("h"), lit("."), pick("t", "com", "org", "net", "example.com"))
    asked = pick("p", "call ", "phone: ", "tel ", "mobile ", "fax ", "reach me on ")
    name = pick("n", "password", "passwd", "pwd", "secret", "token", "api_key", "access_key")
    gives = pick("s", "=", ": ", " = ", ' = "', '="', ":")
    personal = [
        [
            c(word("a"), lit("."), digits("d", 2), pick("at", lit("(at)"), lit(" (at) "), lit("[at]"), lit(" @ ")), host),
            c(pick("p", "call ", "phone: ", "tel ", "reach me on ", ""), lit("("), digits("d", 3), lit(") "), digits("e", 3), pick("s", "-", " ", "."), digits("f", 4)),
            c(asked, digits("d", 3), pick("s", "-", " ", "."), digits("e", 3), pick("s", "-", " ", "."), digits("f", 4)),
            c(asked, lit("1"), pick("s", "-", " "), digits("d", 3), pick("s", "-", " "), digits("e", 3), pick("s", "-", " "), digits("f", 4)),
            c(asked, digits("d", 10)),
            c(name, gives, hexes("x", 18)),
            c(name, gives, hexes("x", 40)),
            c(name, gives, word("a"), digits("d", 4), pick("e", "!", "x", "Z", "q")),
            c(lit("AKIA"), capitals("k")),
            c(pick("n", "sk_live_", "ghp_", "xoxb-"), capitals("k"), hexes("x", 12)),
        ],
        [
            c(word("a"), lit("_"), word("b"), pick("at", lit("[at]"), lit(" [at] "), lit("(at)")), word("h"), pick("dot", "(dot)", "[dot]", " (dot) "), pick("t", "com", "org", "net")),
            c(asked, lit("0"), digits("d", 4), lit(" "), digits("e", 6)),
            c(asked, digits("d", 3), lit("-"), digits("f", 4)),
            c(asked, lit("("), digits("d", 3), lit(")"), pick("s", "-", " ", "."), digits("e", 3), lit("-"), digits("f", 4)),
            c(name, gives, mixed("x", 24)),
            c(name, gives, mixed("x", 12)),
            c(pick("n", "pwd", "secret"), gives, digits("d", 3), word("a"), digits("e", 3)),
            c(lit("ASIA"), capitals("k")),
            c(pick("n", "rk_live_", "gho_", "glpat-"), mixed("k", 20)),
        ],
    ]
    harmless = [
        [
            c(word("a"), lit(" (at) "), word("b"), lit(" . "), word("c")),
            c(pick("p", "version ", "release ", "build "), digits("d", 2), lit("."), digits("e", 2), lit("."), digits("f", 3)),
            c(pick("p", "", "on ", "date "), lit("20"), digits("d", 2), lit("-"), digits("e", 2), lit("-"), digits("f", 2)),
            c(pick("p", "order ", "item ", "ticket ", "isbn "), digits("d", 4), lit(" "), digits("e", 4), lit(" "), digits("f", 4)),
            c(digits("d", 2), lit(" "), digits("e", 2), lit(" "), digits("f", 2)),
            c(digits("d", 3), pick("s", " ", "-", "."), digits("e", 3)),
            c(pick("p", "about ", "over ", ""), digits("d", 7)),
            c(pick("n", "password", "token", "secret"), pick("s", ": ", " = "), pick("w", "required", "forgotten", "expired", "invalid", "optional")),
            c(pick("p", "commit ", "build "), hexes("x", 40)),
            c(word("a"), lit("-"), word("b"), lit("-"), word("c"), lit("-"), digits("d", 1)),
            c(word("a"), lit("_"), word("b"), lit("_"), word("c"), lit("_"), digits("d", 2)),
            c(word("a"), lit("/"), word("b"), lit("/"), word("c"), digits("d", 2)),
            c(digits("d", 8), digits("e", 9)),
            c(lit("="), F.repeat(lit("="), 20), digits("d", 1)),
            c(hexes("x", 8), lit("-"), hexes("y", 4), lit("-"), hexes("z", 4), lit("-"), hexes("v", 12)),
        ],
        [
            c(word("a"), lit(" (at) the "), word("b")),
            c(pick("p", "since ", "from "), lit("19"), digits("d", 2), lit("-"), lit("19"), digits("e", 2)),
            c(digits("d", 2), lit("."), digits("e", 2), lit(".20"), digits("f", 2)),
            c(pick("p", "page ", "no. ", "item ", ""), digits("d", 5), lit(" "), digits("e", 3)),
            c(pick("p", "a total of ", "some ", ""), digits("d", 3), lit(" "), digits("e", 3), lit(" "), digits("f", 3)),
            c(pick("p", "id ", "row ", ""), digits("d", 9)),
            c(pick("n", "password", "token", "pwd"), pick("s", ": ", " = ", "="), pick("w", "disabled", "unknown", "changed", "missing", "nothing")),
            c(pick("p", "digest ", "md5 of it is "), hexes("x", 32)),
            c(pick("p", "sha256 ", "checksum "), hexes("x", 64)),
            c(word("a"), lit("/"), word("b"), lit("/"), word("c"), lit("/"), digits("d", 4)),
            c(word("a"), lit("-"), word("b"), lit("_"), word("c"), lit("-v"), digits("d", 1)),
            c(digits("d", 10), digits("e", 10)),
            c(F.repeat(lit("-"), 20), digits("d", 3)),
        ],
    ]
    rows = spark.range(count).withColumns({"label": (seed("label") % 2).cast("double"), "family": (seed("family") % 2).cast("int")})
    own = lambda k: F.when(F.col("label") == 1, pick("which", *personal[k])).otherwise(pick("which", *harmless[k]))
    text = F.when(F.col("family") == 0, own(0)).otherwise(own(1))
    return rows.select("id", "label", "family", F.concat(word("w1"), lit(" "), word("w2"), lit(" "), text, lit(" "), word("w3"), lit(".")).alias("text"))


class Redactor:
    """The fitted trees and thresholds, as SQL expressions over a candidate."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[int, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def probability(self, c: Column) -> Column:
        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            margin = margin + F.lit(weight) * _tree_value(tree, c)
        return 1 / (1 + F.exp(-2 * margin))

    def accepted(self, c: Column) -> Column:
        threshold = F.lit(2.0)
        for kind, least in self.thresholds.items():
            threshold = F.when(c["kind"] == kind, F.lit(least)).otherwise(threshold)
        return self.probability(c) >= threshold

    def spans(self, text: Column, base: Column | None = None) -> Column:
        """Exact and added spans of a piece: array of start, kind, end, what, by start and then kind; ``base`` if they are known."""
        meets = lambda b, c: (b["start"] < c["end"]) & (c["start"] < b["end"])

        def with_added(base: Column) -> Column:
            passed = F.array_sort(_plain(F.filter(candidates(text), self.accepted)))
            # Stretches of the base by what they reach over, so that a candidate is compared with near ones alone.
            reach = F.transform(stretches(base), lambda bs: F.struct(F.array_min(F.transform(bs, lambda b: b["start"])).alias("start"), F.array_max(F.transform(bs, lambda b: b["end"])).alias("end"), bs.alias("own")))
            clear = let(reach, lambda rs: F.filter(passed, lambda c: ~F.exists(rs, lambda r: meets(r, c) & F.exists(r["own"], lambda b: meets(b, c)))))
            take = lambda upto, out, c: (F.greatest(upto, F.when(c["start"] >= upto, c["end"]).otherwise(upto)), F.when(c["start"] >= upto, F.concat(out, F.array(c))).otherwise(out))
            added = F.when(F.size(base) == 0, passed).otherwise(clear)
            return F.when(F.size(passed) == 0, base).otherwise(F.array_sort(F.concat(base, let(added, lambda xs: walked(xs, F.lit(0), take)))))

        return let(base_spans(text) if base is None else base, with_added)


def _tree_value(node, c: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(c[FEATURES[feature]] <= threshold, _tree_value(left, c)).otherwise(_tree_value(right, c))


def _read_tree(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (split.featureIndex(), float(split.threshold()), _read_tree(node.leftChild()), _read_tree(node.rightChild()))


def fit(spark: SparkSession, precision: float = PRECISION, rounds: int = 12) -> Redactor:
    """Trees from one family of the made texts, thresholds from the other."""
    made = made_texts(spark).select("id", "label", "family", F.explode(candidates(F.col("text"))).alias("c")).select("id", "label", "family", "c.*")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made).select("id", "label", "family", "kind", "features")
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=4, stepSize=0.3, seed=7).fit(rows.where("family = 0").coalesce(1))
    p = F.round(vector_to_array("probability")[1], 6).alias("p")
    judged = model.transform(rows.where("family = 1")).select("kind", "label", p).groupBy("kind", "p").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
    falling = Window.partitionBy("kind").orderBy(F.desc("p"))
    passing = judged.select("kind", "p", (F.sum("hits").over(falling) / F.sum("n").over(falling)).alias("precision")).where(F.col("precision") >= precision)
    thresholds = {r.kind: r.p - 1e-6 for r in passing.groupBy("kind").agg(F.min("p").alias("p")).collect()}
    trees = [_read_tree(t._call_java("rootNode")) for t in model.trees]
    return Redactor(trees, [float(w) for w in model.treeWeights], thresholds)


def find_personal_data(docs: DataFrame, redactor: Redactor | None = None) -> DataFrame:
    """doc_id, base (exact spans) and spans (with the added ones) of every document."""
    redactor = redactor or fit(docs.sparkSession)
    search = lambda p: let(base_spans(p["text"]), lambda base: F.struct(moved(base, p["at"]).alias("base"), moved(redactor.spans(p["text"], base), p["at"]).alias("spans")))
    rows = docs.select("doc_id", F.transform(pieces(F.coalesce("text", F.lit(""))), search).alias("found"))
    return rows.select("doc_id", F.flatten("found.spans").alias("spans"), F.flatten("found.base").alias("base"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The piece with each run of overlapping spans replaced by the first one's kind, in brackets."""
    names = F.array(*map(F.lit, KINDS))
    run = lambda start, end, kind: F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"))
    own = lambda s: run(s["start"], s["end"], s["kind"])

    def merge(open_: Column, out: Column, s: Column) -> tuple[Column, Column]:
        inside = s["start"] < open_["end"]
        return F.when(inside, run(open_["start"], F.greatest(open_["end"], s["end"]), open_["kind"])).otherwise(own(s)), F.when(inside, out).otherwise(F.concat(out, F.array(open_)))

    def cut(runs: Column) -> Column:
        blocks = F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{BLOCK_CHARS}}}"), F.lit(0))

        def between(held: Column, a: Column, b: Column) -> Column:
            first = (a / BLOCK_CHARS).cast("int")
            near = F.array_join(F.slice(held, first + 1, ((b - 1) / BLOCK_CHARS).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(near, a - first * BLOCK_CHARS + 1, b - a)).otherwise("")

        upto = lambda i: F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)
        parts = lambda held: F.transform(runs, lambda r, i: F.concat(between(held, upto(i), r["start"]), F.lit("["), F.upper(F.element_at(names, r["kind"] + 1)), F.lit("]")))
        return let(blocks, lambda held: F.concat(F.array_join(parts(held), ""), between(held, F.element_at(runs, -1)["end"], F.length(text))))

    # The first span opens the first run; what is walked are the others.
    runs = walked(F.slice(spans, 2, F.size(spans)), own(F.element_at(spans, 1)), merge, own)
    return F.when(F.size(spans) == 0, text).otherwise(let(runs, cut))


def redact(docs: DataFrame, redactor: Redactor | None = None) -> DataFrame:
    """The documents, with all their columns, their texts redacted and n_chars made to agree."""
    redactor = redactor or fit(docs.sparkSession)
    # One column after another, as nesting all of it takes the analyzer too many rounds.
    name = free_name(docs, "pieces")
    cut = docs.withColumn(name, F.transform(pieces(F.col("text")), lambda p: F.struct(p["text"].alias("text"), redactor.spans(p["text"]).alias("spans"))))
    out = cut.withColumn("text", F.array_join(F.transform(name, lambda p: redacted(p["text"], p["spans"])), "")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
