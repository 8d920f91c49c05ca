"""Personal data by candidate gradient boosting, with DataFrame functions only.

Four base patterns give spans that always stay. Wide generators propose further, overlapping candidates; boosted trees
score them by format and context, and a threshold calibrated for each generator selects those to add. The trees are
compiled to one expression that runs inside the row: no span leaves its document, and nothing is shuffled.

What is personal is learnt from texts of which it is known: a fixed number of personal values and of look-alikes, made from
hashes and put between other words. Candidates of the documents themselves are unlabelled; those that a model of the planted
ones finds as personal as these are left out, and the others count as not personal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sample_ids

#: The base kinds in their order. Possessive forms of the definitions: a match starts at the start of a run or at the end of the
#: match before, so each text is scanned once; what a definition would match and then drop is left out where a run shows it.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates: high recall, low precision. `token` needs a digit besides.
WIDE = {
    "wide_email": r"(?<![^\s@])[^\s@]++@[^\s@]++",
    "token": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "number": r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,40}+",
}
KINDS = [*BASE, "contact", "secret", "number"]
ADDED = dict(zip(WIDE, KINDS[4:]))
FEATURES = [
    *("gen", "chars", "digits", "letters", "upper", "marks", "hex", "runs", "distinct", "groups", "plus", "at", "dots", "domain", "luhn"),
    *("key_before", "call_before", "pay_before", "word_before", "opened", "closed"),
]
#: Documents and candidates of theirs that the trees learn from, at most, and planted texts, always as many.
SAMPLE_DOCS, SAMPLE_CANDIDATES, PLANTED = 20_000, 50_000, 6_000
#: The share of true ones that a threshold must reach, and the imagined selections, half of them true, that are added to those counted.
PRECISION, IMAGINED = 0.97, 4
#: Share of planted values whose first score an unlabelled candidate may not reach.
SPIES = 0.1
#: Numbers drawn for each planted text.
LOTS = 64
CONTEXT = 24


def _spans(df: DataFrame, text: str, patterns: dict[str, str], guard: Column, prefix: str) -> DataFrame:
    """Add a column `prefix`+name for each pattern: its matches as (s, e, v), in code points, end exclusive.

    Matches alternate with the pieces that `split` leaves, so lengths add up to positions.
    """
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    found = df.withColumns(
        {f"{prefix}{n}_m": F.when(guard, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))) for n, p in patterns.items()}
        | {f"{prefix}{n}_p": F.when(guard, F.split(F.col(text), p, -1)) for n, p in patterns.items()}
    )

    def place(n: str) -> Column:
        pieces = F.col(f"{prefix}{n}_p")
        both = F.transform(F.col(f"{prefix}{n}_m"), lambda v, i: F.struct(v.alias("v"), (F.length(F.get(pieces, i)) + F.length(v)).alias("w")))
        ends = lambda a: F.zip_with(a, _scan(F.transform(a, lambda x: x["w"]), lambda x, y: x + y, 0), lambda x, e: F.struct((e - F.length(x["v"])).alias("s"), e.alias("e"), x["v"].alias("v")))
        return F.when(F.size(f"{prefix}{n}_m") > 0, _let(both, ends)).otherwise(none)

    placed = found.withColumns({f"{prefix}{n}": place(n) for n in patterns})
    return placed.drop(*[f"{prefix}{n}_{x}" for n in patterns for x in "mp"])


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _scan(values: Column, op, zero: int) -> Column:
    """Running results of an associative `op` over a non-empty array of int.

    In chunks of the square root of the length: an array grows by copying, so one chunk would cost its square.
    """
    start = F.struct(F.lit(zero).alias("last"), F.array().cast("array<int>").alias("out"))

    def inside(c: Column) -> Column:
        step = lambda a, v: _let(op(a["last"], v), lambda x: F.struct(x.alias("last"), F.concat(a["out"], F.array(x)).alias("out")))
        return F.aggregate(c, start, step, lambda a: a["out"])

    def carried(chunks: Column) -> Column:
        step = lambda a, c: F.struct(op(a["last"], F.element_at(c, -1)).alias("last"), F.concat(a["out"], F.array(a["last"])).alias("out"))
        before = F.aggregate(chunks, start, step, lambda a: a["out"])
        return F.flatten(F.zip_with(chunks, before, lambda c, k: F.transform(c, lambda x: op(k, x))))

    def chunked(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1, width), lambda i: inside(F.slice(v, i + 1, width)))

    return _let(_let(values, chunked), carried)


def _apart(found: Column, held: Column) -> Column:
    """Those of `found` that overlap none of `held`; both are arrays of structs with s and e."""
    far = (1 << 31) - 1

    def pick(x: Column) -> Column:
        mine, theirs = x["f"], x["h"]
        row = lambda s, of, e, i: F.struct(s.alias("s"), of.alias("of"), e.alias("e"), i.alias("i"))
        order = F.array_sort(F.concat(F.transform(theirs, lambda h: row(h["s"], F.lit(0), h["e"], F.lit(0))), F.transform(mine, lambda f, i: row(f["s"], F.lit(1), f["e"], i))))

        def clear(o: Column) -> Column:
            ended = _scan(F.transform(o, lambda r: F.when(r["of"] == 0, r["e"]).otherwise(0)), F.greatest, 0)
            begins = F.reverse(_scan(F.transform(F.reverse(o), lambda r: F.when(r["of"] == 0, r["s"]).otherwise(far)), F.least, far))
            return _let(F.struct(ended.alias("x"), begins.alias("y")), lambda z: F.filter(o, lambda r, i: (r["of"] == 1) & (F.get(z["x"], i) <= r["s"]) & (F.get(z["y"], i) >= r["e"])))

        return F.transform(_let(order, clear), lambda r: F.get(mine, r["i"]))

    return F.when((F.size(found) == 0) | (F.size(held) == 0), found).otherwise(_let(F.struct(found.alias("f"), held.alias("h")), pick))


def _with(f, *args):
    """A lambda of one column with the other arguments bound (lambdas of more arguments mean something else to Spark)."""
    return lambda x: f(x, *args)


def _span(x: Column, kind: int) -> Column:
    return F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    n = F.length(d)

    def term(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return F.when(i % 2 == 1, x).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), term), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return (n > 0) & (total % 10 == 0)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x["v"], r"\.", -1), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(x["v"])).between(14, 19) & _luhn(x["v"])
    if kind == "phone":
        return F.length(_digits(x["v"])).between(10, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds `_g_text` and `_g_base`, an array of (s, k, e) with k the kind's place in KINDS, in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_g_text", text).withColumn("_g_on", F.col("_g_text").rlike("[0-9@]"))
    df = _spans(df, "_g_text", BASE, F.col("_g_on"), "_g_b_")
    parts = [
        F.transform(F.filter(f"_g_b_{n}", _with(lambda x, kind: _valid(kind, x), n)), _with(_span, k))
        for k, n in enumerate(BASE)
    ]
    return df.withColumn("_g_base", F.array_sort(F.concat(*parts))).drop(*[f"_g_b_{n}" for n in BASE])


def _features(text: Column, x: Column, gen: int) -> Column:
    v, flag = x["v"], lambda c: c.cast("double")
    before = F.lower(F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT))))
    n = lambda keep: F.length(F.regexp_replace(v, f"[^{keep}]", "")).cast("double")
    size = F.greatest(F.length(v), F.lit(1)).cast("double")
    values = {
        "gen": F.lit(float(gen)),
        "chars": F.length(v).cast("double") if gen < 2 else n("0-9"),
        "digits": n("0-9") / (20.0 if gen == 2 else size),  # of a number, how many: their share only tells how it is punctuated
        "letters": n("A-Za-z") / size,
        "upper": n("A-Z") / size,
        "marks": n(r"\x20().\-_") if gen < 2 else (F.size(F.split(v, "[0-9]+", -1)) - 1).cast("double"),  # of a number, its groups of digits
        "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$")),
        "runs": (F.size(F.split(v, "[0-9]+", -1)) - 1) / size,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / size,
        "groups": flag(v.rlike(r"^[+(]?([0-9]{3}[)\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|([0-9]{4}[\x20.-]){3}[0-9]{4})$")),
        "plus": flag(F.startswith(v, F.lit("+")) | F.startswith(v, F.lit("00"))),
        "at": (F.size(F.split(v, "@", -1)) - 1).cast("double"),
        "dots": n("."),
        "domain": flag(v.rlike(r"[^@]@[^@\s.]+(\.[^@\s.]+)*\.\p{L}{2,}[\p{P}\p{S}]*$")),
        "luhn": flag(_luhn(v)) if gen == 2 else F.lit(0.0),
        "key_before": flag(before.rlike(r"(token|secret|key|passw|passwd|password|pwd|auth|bearer|credential)s?[\"']?\s*[=:]?\s*[\"']?$")),
        "call_before": flag(before.rlike(r"(tel|phone|call|mobile|fax|contact|reach)[^a-z]{0,4}$")),
        "pay_before": flag(before.rlike(r"(card|visa|iban|account|acct|ssn)[^a-z]{0,4}$")),
        "word_before": flag(before.rlike(r"\p{L}[\s]*$")),
        "opened": flag(before.rlike(r"[\"'=:(]\s*$")),
        "closed": flag(F.substring(text, x["e"] + 1, F.lit(1)).rlike(r"[\"')]")),
    }
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), *[values[f].cast("double").alias(f) for f in FEATURES])


def candidates(df: DataFrame) -> DataFrame:
    """Adds `_g_cand`: the generators' candidates with their features. Needs `base_spans`."""
    df = _spans(df, "_g_text", WIDE, F.col("_g_on"), "_g_w_")
    parts = []
    for g, n in enumerate(WIDE):
        own = F.filter(f"_g_w_{n}", lambda x: x["v"].rlike("[0-9]")) if n == "token" else F.col(f"_g_w_{n}")
        parts.append(F.transform(own, _with(lambda x, gen: _features(F.col("_g_text"), x, gen), g)))
    return df.withColumn("_g_cand", F.concat(*parts)).drop(*[f"_g_w_{n}" for n in WIDE])


@dataclass
class SpanModel:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values, their weights, and a threshold per generator."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, x: Column) -> Column:
        """Probability that a candidate is personal data."""

        def node(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            f, cut, left, right = t
            return F.when(x[FEATURES[f]] <= cut, node(left)).otherwise(node(right))

        margin = F.lit(0.0)
        for t, w in zip(self.trees, self.weights):
            margin = margin + node(t) * w
        return 1 / (1 + F.exp(-2 * margin))


def _parse(tree: str):
    """Nested tuples from a tree's debug string."""
    lines = [x.strip() for x in tree.splitlines()[1:] if x.strip()]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        m = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
        left = node()
        at += 1  # Else
        return int(m[1]), float(m[2]), left, node()

    return node()


def planted(spark: SparkSession, rows: int = PLANTED, seed: str = "planted", without: dict[int, int] | None = None, only: dict[int, int] | None = None) -> DataFrame:
    """(text, s, e, label, g): `rows` texts, each with a value at [s, e) that is personal (1) or looks like it (0), of the kind of generator g.

    `without` leaves one personal format of a generator out, `only` takes no other: how formats that the trees haven't seen fare is measured so.

    Values, the words around them and what introduces them are drawn by hash. A tenth of each have the others' introduction.
    """
    lots = F.transform(F.sequence(F.lit(0), F.lit(LOTS - 1)), lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(1 << 28)).cast("int"))
    base = spark.range(rows).select("id", F.sha2(F.concat_ws("|", F.lit(seed), F.col("id")), 256).alias("h"), lots.alias("lots"))
    base = materialise(base, "pii-lots")  # what follows stays a small expression
    names: dict[str, int] = {}
    drawn = lambda part: F.get("lots", F.lit(names.setdefault(part, len(names)) % LOTS))
    of = lambda part, options: F.get(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), drawn(part) % len(options))
    some = lambda part, n: F.lpad((drawn(part) % 10**n).cast("string"), n, "0")
    digits = lambda part, n: some(part, n) if n < 8 else F.concat(some(part, 7), digits(part + "'", n - 7))
    word = lambda part: of(part, WORDS)
    h, join = F.col("h"), F.concat
    mixed = F.translate(F.base64(F.unhex("h")), "+/=", "xYz")
    card = join(F.lit("4"), digits("card", 14))
    check = F.get(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: _luhn(F.concat(card, d))), F.lit(0))
    grouped = lambda n, mark: F.regexp_replace(n, "([0-9]{4})(?=[0-9])", f"$1{mark}")
    area, line = digits("area", 3), digits("line", 4)
    # Formats of personal values: how a value is written varies by parts, so that no part of the writing alone tells the kinds apart.
    end = of("end", [".example.com", ".example.org", ".net", ".co.uk", ".de"])
    plain = join(of("host", [word("b"), join(word("b"), F.lit("-"), word("c")), join(F.lit("mail"), digits("m", 1)), join(word("c"), F.lit("."), word("b"))]), end)
    foreign = join(of("where", [join(F.lit("münch"), digits("n", 2)), join(word("b"), F.lit("ø")), join(F.lit("ñ"), word("b")), join(word("c"), F.lit(".straße"))]), end)
    accent = of("accent", ["é", "ß", "ö", "ł"])
    middle, code = digits("middle", 3), digits("code", 2)
    personal = {
        0: [join(word("a"), accent, F.lit("@"), plain), join(word("a"), F.lit("."), word("d"), F.lit("@"), foreign), join(word("a"), digits("n", 3), accent, F.lit("@"), plain), join(word("a"), F.lit("@"), foreign), join(word("a"), F.lit("_"), word("d"), accent, F.lit("@"), plain), join(word("a"), F.lit("+"), word("d"), digits("n", 2), F.lit("@"), foreign)],
        1: [F.substring(h, 1, 40), F.substring(h, 1, 32), h, F.substring(mixed, 1, 24), F.substring(mixed, 1, 40), join(F.lit("sk_live_"), F.substring(mixed, 1, 24)), join(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")],
        2: [join(F.lit("("), area, F.lit(") "), middle, F.lit("-"), line), join(area, F.lit("-"), middle, F.lit("-"), line), join(area, F.lit(" "), middle, F.lit(" "), line), join(area, F.lit("."), middle, F.lit("."), line), join(F.lit("00"), code, F.lit(" 30 "), digits("d", 8)), join(F.lit("00"), code, F.lit("-"), area, F.lit("-"), digits("d", 7)), join(area, F.lit("-"), digits("s", 2), F.lit("-"), line), grouped(join(card, check), "."), join(F.lit("(0"), code, F.lit(") "), digits("d", 7))],
    }
    alike = {
        0: [join(word("a"), F.lit("@@"), word("b")), join(F.lit("@"), word("a"), F.lit("@"), word("b")), join(digits("n", 1), F.lit("@"), digits("m", 1), F.lit(".00")), join(word("a"), F.lit("@"), word("b"), F.lit("@"), word("c")), join(word("a"), accent, F.lit("@"), word("b")), join(word("a"), F.lit("."), word("d"), F.lit("@"), word("b"), accent), join(word("a"), accent, digits("n", 3), F.lit("@"), word("b"), F.lit("."), digits("m", 2))],
        1: [join(word("a"), F.lit("-of-the-"), word("b"), F.lit("-"), digits("y", 4)), join(F.lit("chapter_"), digits("n", 2), F.lit("_"), word("a"), F.lit("_"), word("b")), join(word("a"), word("b"), word("c"), digits("n", 1)), digits("n", 16), join(F.repeat(word("a"), 4), digits("n", 2)), join(F.lit("20"), digits("y", 2), F.lit("-01-31_"), word("a"), F.lit("-draft"))],
        2: [join(F.lit("20"), digits("y", 2), F.lit("-01-31 10.20.30")), join(F.lit("1 "), digits("a", 3), F.lit(" "), digits("b", 3), F.lit(" "), digits("c", 3)), digits("n", 9), digits("n", 12), join(F.lit("0."), digits("n", 9)), join(digits("a", 3), F.lit("-"), digits("b", 3), F.lit(" "), digits("c", 3)), F.repeat(digits("n", 1), 10), join(F.lit("1.2.3.4.5.6.7."), digits("n", 1)), grouped(digits("n", 16), " "), join(F.lit("19"), digits("y", 2), F.lit("-20"), digits("m", 2)), join(F.lit("978-"), digits("n", 1), F.lit("-"), digits("a", 3), F.lit("-"), digits("b", 5), F.lit("-"), digits("m", 1)), join(digits("m", 2), F.lit(".0"), digits("n", 6)), join(digits("a", 3), F.lit("."), digits("b", 3), F.lit("."), digits("c", 3))],
    }
    own = {0: ["write to ", "mail: ", "<", ""], 1: ['token = "', "api_key: ", "secret='", "Authorization: Bearer ", "password=", 'key = "', "credentials: "], 2: ["call ", "tel: ", "phone ", "contact (", "my card ", "ssn ", ""]}
    other = {0: ["see ", "in ", ""], 1: ["see ", "the ", "in (", 'name = "', "file: "], 2: ["see ", "on ", "about ", "page ", "(", "no. "]}
    if without or only:
        personal = {g: [o for k, o in enumerate(v) if (only is None or only.get(g, k) == k) and (without is None or without.get(g) != k)] for g, v in personal.items()}
    pick = lambda table: F.get(F.array(*[of("kind", table[g]) for g in range(3)]), F.col("g"))
    swapped = (drawn("swap") % 10 == 0) != (F.col("label") == 1)
    made = base.select("h", "lots", (F.col("id") % 3).cast("int").alias("g"), (F.floor(F.col("id") / 3) % 2).cast("double").alias("label"))
    made = made.withColumn("v", F.when(F.col("label") == 1, pick(personal)).otherwise(pick(alike)))
    made = made.withColumn("lead", join(word("p"), F.lit(" "), word("q"), F.lit(" "), F.when(swapped, pick(other)).otherwise(pick(own))))
    after = of("after", ['"', "'", " ", ". ", ", ", ") ", "\n"])
    text = F.concat("lead", "v", after, F.lit(" "), word("z"))
    return made.select(text.alias("text"), F.length("lead").alias("s"), (F.length("lead") + F.length("v")).alias("e"), "label", "g")


#: Words around planted values: of no language, so that none of theirs is taught.
WORDS = "tamo veril osken palti rudo sennet kora ilvan dupre mosta quil benor fane goral histe jurn".split()


def _free(rows: DataFrame) -> DataFrame:
    """Candidates `c` of `rows` that no base span overlaps, one a row."""
    return rows.withColumn("_g_cand", _apart(F.col("_g_cand"), F.col("_g_base"))).where(F.size("_g_cand") > 0).select("*", F.explode("_g_cand").alias("c")).drop("_g_cand", "_g_text", "_g_base", "_g_on")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES, without: dict[int, int] | None = None) -> SpanModel:
    """Boost shallow trees on planted values and on candidates of a bounded sample of documents (by hash of the id), and calibrate thresholds.

    Half of the candidates teach the trees; on the others a generator's threshold is the least score from which the
    selected are true at the rate PRECISION, IMAGINED ones included. Planted texts are as many at any size, so the trees are fitted
    for an empty table too. A generator without such a score adds nothing. `without` is that of `planted`.
    """
    spark = docs.sparkSession
    made = _free(candidates(base_spans(materialise(planted(spark, without=without), "pii-planted"), "text")))
    made = made.where((F.col("c.s") == F.col("s")) & (F.col("c.e") == F.col("e"))).select("label", F.xxhash64("text").alias("o"), "c.*")
    ids = sample_ids(docs, id_col, sample_docs).select(F.col(id_col).alias("_g_sid"))
    picked = docs.select(id_col, text_col).join(F.broadcast(ids), F.col(id_col) == F.col("_g_sid"))
    own = _free(candidates(base_spans(picked, text_col))).select(F.lit(0.0).alias("label"), F.xxhash64("_g_sid", "c.s", "c.e").alias("o"), "c.*")
    own = own.orderBy("o", "s", "e", "gen").limit(sample_candidates)
    known = made.select("*", F.lit(True).alias("made")).unionByName(own.select("*", F.lit(False).alias("made")))
    sample = materialise(known.withColumn("teach", F.pmod("o", F.lit(2)) == 0), "pii-sample")
    features = F.struct(*[F.col(f) for f in FEATURES])
    first = _boost(sample.where("teach AND made"), 6).score(features).alias("first")
    scored = sample.select("*", first)
    spies = scored.where("made AND label = 1").groupBy("gen").agg(F.percentile_approx("first", SPIES, 10_000).alias("least")).collect()
    least = F.coalesce(*[F.when(F.col("gen") == r.gen, F.lit(r.least)) for r in spies], F.lit(2.0))
    sure = materialise(scored.where(F.col("made") | (F.col("first") < least)).drop("first"), "pii-sure")
    model = _boost(sure.where("teach"), 12)
    score = F.floor(model.score(features) * 100).cast("int").alias("score")
    held = sure.where("not teach").select("gen", score, "label").groupBy("gen", "score").agg(F.count("*").alias("n"), F.sum("label").alias("true")).collect()
    for g in range(len(WIDE)):
        n, true = IMAGINED, IMAGINED / 2
        for r in sorted((r for r in held if r.gen == g), key=lambda r: -r.score):
            n, true = n + r.n, true + r.true
            if true >= PRECISION * n:
                model.thresholds[g] = r.score / 100
    return model


def _boost(rows: DataFrame, trees: int) -> SpanModel:
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows.orderBy("o", "s", "e", "gen")).coalesce(2)
    gbt = GBTClassifier(labelCol="label", featuresCol="x", maxIter=trees, maxDepth=4, maxBins=32, stepSize=0.3, seed=7).fit(assembled)
    return SpanModel([_parse(t.toDebugString) for t in gbt.trees], [float(w) for w in gbt.treeWeights])


def personal_data(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: the id, `n_email`, `n_ip`, `n_card`, `n_phone`, `base_sha256`, `spans`, `n_spans`, and `redactions` (array of s, kind, e).

    Null text is empty text: no spans, and the digest of nothing. Rows are independent, repeated or not, whatever their id.
    An added span overlaps no base span and no span added by an earlier generator. An empty table gives none.
    """
    df = candidates(base_spans(docs.select(id_col, text_col), text_col)).withColumn("_g_all", F.col("_g_base"))
    for g, limit in sorted(model.thresholds.items()):
        own = F.filter("_g_cand", _with(lambda c, gen, least: (c["gen"] == gen) & (model.score(c) >= least), g, limit))
        spans = F.transform(own, _with(_span, KINDS.index(ADDED[list(WIDE)[g]])))
        df = df.withColumn("_g_own", spans).withColumn("_g_all", F.concat("_g_all", _apart(F.col("_g_own"), F.col("_g_all"))))
    df = df.withColumn("_g_all", F.array_sort("_g_all"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    counts = [F.size(F.filter("_g_base", _with(lambda x, kind: x["k"] == kind, k))).cast("long").alias(f"n_{n}") for k, n in enumerate(BASE)]
    return df.select(
        F.col(f"`{id_col}`"),
        *counts,
        F.sha2(text("_g_base"), 256).alias("base_sha256"),
        text("_g_all").alias("spans"),
        F.size("_g_all").cast("long").alias("n_spans"),
        F.transform("_g_all", lambda x: F.struct(x["s"].alias("s"), F.get(names, x["k"]).alias("kind"), x["e"].alias("e"))).alias("redactions"),
    )
