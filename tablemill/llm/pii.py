"""Personal data: generators propose spans, boosted trees judge those that no check decides, thresholds are calibrated.

Four base kinds have checks of their own and always stay. Six further kinds are proposed by generators of high recall, whose spans
may overlap each other and base ones, and are judged by gradient-boosted trees over the format of a candidate and the text before it.
The trees are fitted here, on examples put between words of a bounded sample of the texts (true ones, and decoys of the same
shape), and become a column expression. For each kind, held-out examples calibrate the lowest score of which enough are true.

Everything is DataFrame and SQL functions. Places of matches come from one replacement that puts a mark at both ends of each
match: the lengths of what lies between marks add up to places. Rows don't meet, so nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import fresh, staged, text_of

#: Texts that the examples are put into, and examples for each of them: the bounds of what the model is fitted on.
SAMPLE_TEXTS, EXAMPLES = 1500, 6
#: The share of true ones that a kind's candidates must have, by held-out examples, from its threshold on.
PRECISION = 0.95
#: No threshold is below even odds, however well the held-out examples come apart.
LEAST_SCORE = 0.5
#: Trees, and their depth.
TREES, DEPTH = 12, 3
#: Characters before a candidate that count as its context.
CONTEXT = 32

_AROUND = 80  # characters of a text around an example
_MARK, _INSTEAD = "\x01", "\x02"
_BLOCK = 256  # an even number, so that each block begins outside of a match
_SPAN = "array<struct<start:int,end:int,value:string,before:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: part.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda value: F.length(_digits(value)).between(low, high)


#: Base kinds in the order in which they are listed: a character that a match needs, the expression, whether a match holds.
#: Expressions are possessive and begin at the start of a run, or where the last match ended, so each character is read a few times at most.
BASE: dict[str, tuple[str | None, str, Callable[[Column], Column]]] = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True)),
    "ip": (".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets),
    "card": (None, r"[0-9](?:[\x20-]?+[0-9])++", lambda v: _between(12, 19)(v) & _luhn(_digits(v))),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]", _between(9, 15)),
}


@dataclass(frozen=True)
class Kind:
    """A kind that the trees judge: its generator, words that speak for it, and a check of its form."""

    shape: str
    cue: str
    form: Callable[[Column], Column] = field(default=lambda value: F.lit(False))


def _iban_holds(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    number = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.between("A", "Z"), 100).otherwise(10) + number(c)) % 97)) == 1


def _date_holds(value: Column) -> Column:
    day, month, year = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:19[0-9]{2}|20[0-2][0-9])"
    return value.rlike(f"^{year}[-/.]{month}[-/.]{day}$|^{day}[-/.]{month}[-/.]{year}$|^{month}[-/.]{day}[-/.]{year}$")


#: Quantifiers are bounded, so a generator reads each character a bounded number of times.
KINDS: dict[str, Kind] = {
    "local_phone": Kind(r"[(0-9](?<![0-9A-Za-z+_.(-].)[0-9]{2,4}\)?[\x20./-]{0,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z_-])", r"call|phone|tel\b|mobile|cell|fax|reach", lambda v: v.rlike(r"^\(?[2-9][0-9]{2}\)?[^0-9]*[2-9]")),
    "ssn": Kind(r"[0-9](?<![0-9A-Za-z_-].)[0-9]{2}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z_-])", r"ssn|social|security|tax", lambda v: v.rlike(r"^(?!000|666|9)[0-9]{3}.(?!00)[0-9]{2}.(?!0000)[0-9]{4}$")),
    "iban": Kind(r"[A-Z](?<![0-9A-Za-z_].)[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z_])", r"iban|account|konto|bank|transfer", _iban_holds),
    "spelled_email": Kind(r"(?i)[a-z0-9](?<![a-z0-9._-].)[a-z0-9._-]{0,63}\x20?[\[({]?(?:\x20at\x20|(?<=[\[({])at(?=[\])}]))[\])}]?\x20?[a-z0-9-]{1,63}\x20?[\[({]?(?:\x20dot\x20|(?<=[\[({])dot(?=[\])}]))[\])}]?\x20?[a-z]{2,12}(?![a-z0-9])", r"mail|contact|write|reach", lambda v: v.rlike(r"(?i)[^a-z](?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$")),
    "birth_date": Kind(r"[0-9](?<![0-9A-Za-z_./-].)[0-9]{0,3}[-/.][0-9]{1,2}[-/.][0-9]{1,4}(?![0-9A-Za-z_/-])", r"born|birth|dob\b|geboren|nacid|n[ée]e?\b", _date_holds),
    "dotted_card": Kind(r"[0-9](?<![0-9A-Za-z_./-].)[0-9]{3}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9A-Za-z_./-])", r"card|visa|credit|debit|karte|pay", lambda v: _luhn(_digits(v))),
}
_DECOY = r"(?i)order|invoice|version|\bv\b|build|ref|sku|isbn|ticket|part|serial|model|item|page|room|released|updated|since"
ALL = (*BASE, *KINDS)
FEATURES = ("kind", "digits", "size", "groups", "form", "cue", "decoy", "close", "brackets")


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _parts(text: Column, shape: str) -> Column:
    """What lies between matches and the matches, by turns. A match has no marks; a text's own are replaced by another character first."""
    return F.split(F.regexp_replace(F.translate(text, _MARK, _INSTEAD), f"({shape})", f"{_MARK}$1{_MARK}"), _MARK)


def matches(text: Column, shape: str) -> Column:
    """All leftmost matches that don't overlap: (start, end, value, before), in code points, end exclusive.

    Places are added up within blocks of _BLOCK parts and then over the blocks, as growing one array match by match would take
    quadratic time.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit("").alias("before"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value"), acc["before"].alias("before"))
        found = F.when(acc["inside"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.substring(part, -CONTEXT, CONTEXT).alias("before"), found.alias("found"))

    def block(parts: Column) -> Callable[[Column], Column]:
        return lambda k: F.aggregate(F.slice(parts, k * _BLOCK + 1, _BLOCK), start, step, lambda acc: F.struct(acc["at"], acc["found"]))

    def moved(by: Column) -> Callable[[Column], Column]:
        return lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"], s["before"])

    def join(acc: Column, piece: Column) -> Column:
        return F.struct((acc["at"] + piece["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(piece["found"], moved(acc["at"])))).alias("out"))

    def placed(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int")), block(parts))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), join, lambda acc: F.flatten(acc["out"]))

    return _with(_parts(text, shape), placed)


def _without_base(text: Column) -> Column:
    """The text with what base spans cover replaced, one by one for each kind, by a character that no generator takes."""

    def hidden(holds: Callable[[Column], Column]) -> Callable[[Column], Column]:
        one = lambda part, k: F.when((k % 2 == 1) & holds(part), F.repeat(F.lit(_INSTEAD), F.length(part))).otherwise(part)
        return lambda parts: F.array_join(F.transform(parts, one), "")

    for _, shape, holds in BASE.values():
        text = _with(_parts(text, shape), hidden(holds))
    return text


def _base(text: Column, kind: str) -> Column:
    needed, shape, holds = BASE[kind]
    found = F.filter(matches(text, shape), lambda s: holds(s["value"]))
    return found if needed is None else F.when(F.contains(text, F.lit(needed)), found).otherwise(F.array().cast(_SPAN))


def features(kind: str, value: Column, before: Column) -> list[Column]:
    """What the trees see of a candidate, as doubles in the order of FEATURES."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    groups = F.length(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[^9]", ""))
    said = [
        F.lit(float(list(KINDS).index(kind))), F.length(_digits(value)).cast("double"), F.length(value).cast("double"), groups.cast("double"), flag(KINDS[kind].form(value)), flag(before.rlike(f"(?i){KINDS[kind].cue}")),
        flag(before.rlike(_DECOY)), flag(before.rlike(r"[#$%=/_A-Za-z0-9]$")), flag(value.rlike(r"[\[({]")),
    ]
    return [c.alias(n) for c, n in zip(said, FEATURES, strict=True)]


def candidates(text: Column, kind: str) -> Column:
    """Spans that the kind's generator proposes, with their features."""
    return F.transform(matches(text, KINDS[kind].shape), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *features(kind, s["value"], s["before"])))


# examples


def _drawn(salt: int, low: int, high: int) -> Column:
    """A number from low up to high, exclusive, by a hash of the example."""
    return F.pmod(F.xxhash64("_text", "_example", F.lit(salt)), F.lit(high - low)) + low


def _number(salt: int, digits: int) -> Column:
    return F.lpad(_drawn(salt, 0, 10**digits).cast("string"), digits, "0")


def _one_of(salt: int, *choices: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) if isinstance(c, str) else c for c in choices]), (_drawn(salt, 0, len(choices)) + 1).cast("int"))


def _iban(salt: int, good: bool) -> Column:
    account = _number(salt, 18)
    rest = (account.cast("decimal(38,0)") * 1000000 + 131400) % 97  # D and E are 13 and 14
    check = F.lpad((F.lit(98) - rest).cast("int").cast("string"), 2, "0") if good else _number(salt + 1, 2)
    plain = F.concat(F.lit("DE"), check, account)
    return _one_of(salt + 2, plain, F.trim(F.regexp_replace(plain, "(.{4})", "$1 ")))


def _card(salt: int, good: bool) -> Column:
    base = F.concat(_drawn(salt, 3, 7).cast("string"), _number(salt + 1, 14))
    last = F.filter(F.split(F.lit("0123456789"), ""), lambda d: (d != "") & (_luhn(F.concat(base, d)) if good else ~_luhn(F.concat(base, d))))
    mark = _one_of(salt + 2, ".", "/", "_")
    whole = F.concat(base, F.element_at(last, 1))
    return F.concat_ws("", *[x for k in range(4) for x in ([mark] if k else []) + [F.substring(whole, 4 * k + 1, 4)]])


def _date(salt: int) -> Column:
    year, month, day = _drawn(salt, 1930, 2025).cast("string"), F.lpad(_drawn(salt + 1, 1, 13).cast("string"), 2, "0"), F.lpad(_drawn(salt + 2, 1, 29).cast("string"), 2, "0")
    return _one_of(salt + 3, F.concat_ws("-", year, month, day), F.concat_ws("/", day, month, year), F.concat_ws(".", day, month, year))


def _templates() -> list[tuple[str, bool, tuple[str, ...], Column]]:
    """(kind, whether true, words before, value)."""
    phone = lambda salt, low, high: _one_of(salt, F.concat(F.lit("("), _drawn(salt + 1, low, high).cast("string"), _number(salt + 2, 2), F.lit(") "), _drawn(salt + 3, low, high).cast("string"), _number(salt + 4, 2), F.lit("-"), _number(salt + 5, 4)), F.concat(_drawn(salt + 1, low, high).cast("string"), _number(salt + 2, 2), F.lit("-"), _drawn(salt + 3, low, high).cast("string"), _number(salt + 4, 2), F.lit("-"), _number(salt + 5, 4)))
    ssn = lambda salt, low, high: F.concat_ws("-", F.lpad(_drawn(salt, low, high).cast("string"), 3, "0"), F.lpad(_drawn(salt + 1, 1, 100).cast("string"), 2, "0"), F.lpad(_drawn(salt + 2, 1, 10000).cast("string"), 4, "0"))
    mail = lambda salt, *ends: F.concat(_one_of(salt, "jane", "j.doe", "info", "sales7"), _one_of(salt + 1, " at ", " [at] ", "(at)"), _one_of(salt + 2, "example", "mail-host", "uni"), _one_of(salt + 3, " dot ", " [dot] ", "(dot)"), _one_of(salt + 4, *ends))
    words = lambda salt: F.concat(_one_of(salt, "look", "meet", "arrive"), F.lit(" at "), _one_of(salt + 1, "noon", "each", "the"), F.lit(" dot "), _one_of(salt + 2, "above", "matrix", "then"))
    odd = ("order", "invoice", "part", "ticket", "version", "ref", "item", "serial")
    return [
        ("local_phone", True, ("call", "phone", "tel", "mobile", ""), phone(100, 2, 10)),
        ("local_phone", False, (*odd, "", ""), phone(110, 0, 2)),
        ("local_phone", False, odd, phone(120, 0, 10)),
        ("ssn", True, ("ssn", "social security number", "tax id", ""), ssn(130, 1, 666)),
        ("ssn", False, ("", *odd), ssn(140, 900, 1000)),
        ("ssn", False, odd, ssn(150, 0, 1000)),
        ("iban", True, ("iban", "account", "bank", ""), _iban(160, True)),
        ("iban", False, ("", "account", *odd), _iban(170, False)),
        ("spelled_email", True, ("mail", "contact", "write to", ""), mail(180, "com", "org", "net", "de")),
        ("spelled_email", False, ("", "you", "we", "then"), words(190)),
        ("birth_date", True, ("born", "date of birth", "dob", "birthday"), _date(200)),
        ("birth_date", False, ("on", "updated", "released", "", "since", "version"), _date(210)),
        ("dotted_card", True, ("card", "visa", "credit card", ""), _card(220, True)),
        ("dotted_card", False, ("", "card", *odd), _card(230, False)),
    ]


def examples(df: DataFrame, text_col: str = "text", texts: int = SAMPLE_TEXTS, each: int = EXAMPLES) -> DataFrame:
    """Candidates found where examples were put: kind_name, good, held_out, and the features. At most texts * each examples."""
    # a few words around places of each text, chosen by a hash; only as many partitions are read as it takes, and only the words are brought here
    text = text_of(df, text_col)
    place = lambda k: (F.pmod(F.xxhash64(text, k), F.greatest(F.length(text), F.lit(1))) + 1).cast("int")
    around = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda k: F.translate(F.substring(text, place(k), F.lit(_AROUND)), "0123456789", ""))
    given = [{"_text": r[0], "_cuts": r[1]} for r in df.select(F.xxhash64(text), around).limit(texts).collect()]
    rows = F.from_json(F.lit(json.dumps(given)), "array<struct<_text:bigint,_cuts:array<string>>>")
    known = df.sparkSession.range(1).select(F.explode(rows).alias("_r")).select("_r._text", F.posexplode("_r._cuts").alias("_example", "_around"))
    templates = _templates()
    at = _drawn(1, 0, len(templates))
    pick = lambda values: reduce(lambda other, k: F.when(F.col("_at") == k, values[k]).otherwise(other), range(len(values)), F.lit(None))
    drawn = known.select("_text", "_example", "_around", at.alias("_at"))
    drawn = drawn.select("*", pick([F.lit(t[0]) for t in templates]).alias("kind_name"), pick([F.lit(t[1]) for t in templates]).alias("good"), pick([_one_of(2, *t[2]) for t in templates]).alias("_cue"), pick([t[3] for t in templates]).alias("_value"))
    left = F.concat(F.substring("_around", 1, 40), F.lit(" "), F.col("_cue"), F.when(F.col("_cue") == "", "").otherwise(_one_of(3, " ", ": ", " is ")))
    put = drawn.select("kind_name", "good", (_drawn(4, 0, 4) == 0).alias("held_out"), F.length(left).alias("_from"), F.concat(left, "_value", _one_of(5, " ", ". ", ", "), F.substring("_around", 41, 40)).alias("_put"))
    put = staged(put, "pii-examples")
    parts = []
    for kind in KINDS:
        found = put.where(F.col("kind_name") == kind).select("kind_name", "good", "held_out", "_from", F.explode(candidates(F.col("_put"), kind)).alias("_c"))
        parts.append(found.where((F.col("_c.end") > F.col("_from")) & (F.col("_c.start") <= F.col("_from"))).select("kind_name", "good", "held_out", *[F.col(f"_c.{n}").alias(n) for n in FEATURES]))
    return reduce(DataFrame.unionByName, parts)


# the model


@dataclass(frozen=True)
class Model:
    """Trees as nested tuples (feature, limit, left, right) or leaves, their weights, and each kind's threshold."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def score(self, of: Callable[[str], Column]) -> Column:
        """The probability that a candidate is true, by its features."""

        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            name, limit, left, right = node
            return F.when(of(name) <= limit, value(left)).otherwise(value(right))

        margin = reduce(lambda a, b: a + b, [value(t) * w for t, w in zip(self.trees, self.weights, strict=True)])
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, kind: str) -> Callable[[Column], Column]:
        return lambda candidate: self.score(lambda name: candidate[name]) >= self.thresholds[kind]


def _tree(lines: list[str]):
    """The tree that Spark describes in indented lines, read from the front."""
    line = lines.pop(0).strip()
    if said := re.match(r"Predict: (\S+)", line):
        return float(said[1])
    number, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _tree(lines)
    lines.pop(0)  # the same condition, the other way round
    return FEATURES[int(number)], float(limit), left, _tree(lines)


def _read(model: GBTClassificationModel) -> tuple[tuple, tuple[float, ...]]:
    return tuple(_tree(t.toDebugString.split("\n")[1:]) for t in model.trees), tuple(model.treeWeights)


def fit(df: DataFrame, text_col: str = "text", texts: int = SAMPLE_TEXTS, each: int = EXAMPLES, precision: float = PRECISION) -> Model | None:
    """A model from examples between the words of at most ``texts`` texts; None if the table is empty, as nothing is proposed then.

    A kind for which no score gives the precision has a threshold above 1, which nothing reaches.
    """
    labelled = staged(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(examples(df, text_col, texts, each)).withColumn("label", F.col("good").cast("double")), "pii-labelled")
    seen = {r["held_out"]: r for r in labelled.groupBy("held_out").agg(F.min("label").alias("least"), F.max("label").alias("most")).collect()}
    if False not in seen or seen[False]["least"] == seen[False]["most"]:
        return None
    trees, weights = _read(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(labelled.where("not held_out").coalesce(1)))
    model = Model(trees, weights, {})
    scored = labelled.where("held_out").select("kind_name", "label", F.floor(model.score(F.col) * 100).alias("score"))
    binned = scored.groupBy("kind_name", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("kind_name").orderBy(F.col("score").desc())
    enough = binned.select("kind_name", "score", ((F.sum("good").over(above) + precision) / (F.sum("n").over(above) + 1) >= precision).alias("enough"))
    lowest = {r["kind_name"]: max(LEAST_SCORE, r["score"] / 100) for r in enough.where("enough").groupBy("kind_name").agg(F.min("score").alias("score")).collect()}
    return Model(trees, weights, {kind: lowest.get(kind, 2.0) for kind in KINDS})


def pii_spans(df: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, name: str = "pii") -> DataFrame:
    """Add ``name``, an array of (start, place of the kind in ALL, end), by start and kind, to every row.

    Within a base kind, matches are leftmost and do not overlap; a match that fails its check still covers its characters.
    Further kinds are those candidates whose score reaches their threshold, in the text outside of base spans. Spans of different kinds may overlap.
    A null or empty text has no spans; an input column of that name is replaced; null and repeated ids play no part.
    """
    span = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(ALL.index(kind)).alias("kind"), s["end"].alias("end"))
    kept = [c for c in (df.columns if keep is None else keep) if c != name]
    (read,) = fresh(df, "_read")
    named = [F.col(f"`{c}`") for c in kept]
    text = F.col(read)
    base = F.concat(*[F.transform(_base(text, kind), span(kind)) for kind in BASE])
    found = df.select(*named, text_of(df, text_col).alias(read)).select(*named, read, base.alias(name))
    if model:
        none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        needs = lambda kind: "(?i)dot" if kind == "spelled_email" else "[0-9]"
        chosen = lambda rest, kind: F.transform(F.filter(candidates(rest, kind), model.selects(kind)), span(kind))
        found = found.select(*named, name, F.when(F.size(F.col(f"`{name}`")) > 0, _without_base(text)).otherwise(text).alias(read))
        found = found.select(*named, F.concat(F.col(f"`{name}`"), *[F.when(text.rlike(needs(kind)), chosen(text, kind)).otherwise(none) for kind in KINDS]).alias(name))
    return found.select(*named, F.array_sort(F.col(f"`{name}`")).alias(name))


def redacted(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with what its spans cover replaced in the text by the kind in brackets; spans that overlap are one, of the first's kind."""
    spans, read = fresh(df, "_spans", "_read")
    marked = pii_spans(df.withColumn(read, text_of(df, text_col)), model, read, name=spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(read), acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.element_at(kinds, s["kind"] + 1)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(F.col(read), acc["at"] + 1, F.length(read)))), ""))
    text = F.when(F.size(spans) > 0, whole).otherwise(F.col(f"`{text_col}`"))
    return marked.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
