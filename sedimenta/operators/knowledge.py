"""Claims, dates, amounts and identities drawn from text by rules, and the groups they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names of the supported languages, by number.
MONTHS = {
    1: "january|januar|janvier|enero|januari",
    2: "february|februar|février|febrero|februari",
    3: "march|märz|mars|marzo|maart",
    4: "april|avril|abril",
    5: "may|mai|mayo|mei",
    6: "june|juni|juin|junio",
    7: "july|juli|juillet|julio",
    8: "august|août|agosto|augustus",
    9: "september|septembre|septiembre",
    10: "october|oktober|octobre|octubre",
    11: "november|novembre|noviembre",
    12: "december|dezember|décembre|diciembre",
}
#: Dates as they are written: ISO, day/month/year with a stroke or points, and day, name of the month, year.
DATE = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/.]\d{1,2}[/.]\d{4}\b|\b\d{1,2}\.? (?:de )?(?:" + "|".join(MONTHS.values()) + r") (?:de )?\d{4}\b"


def month_number(name: Column) -> Column:
    """The number of a month's name, in any of the languages; null for other words."""
    out = F.lit(None).cast("int")
    for n, names in MONTHS.items():
        out = F.when(F.lower(name).rlike(f"^(?:{names})$"), n).otherwise(out)
    return out


def date_readings(surface: Column, day_first_only: Column) -> Column:
    """All days a written date can mean, sorted; none if it is no day. A date with strokes or points may be day-first or month-first unless the language settles it."""
    parts = F.split(surface, r"[/.]")
    named = F.regexp_extract(surface, r"^(\d{1,2})\.? (?:de )?([^\d ]+) (?:de )?(\d{4})$", 2)
    day, year = F.regexp_extract(surface, r"^(\d{1,2})", 1), F.regexp_extract(surface, r"(\d{4})$", 1)
    make = lambda y, m, d: F.to_date(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")))
    numeric = F.array(make(parts[2], parts[1], parts[0]), F.when(~day_first_only, make(parts[2], parts[0], parts[1])))
    found = (
        F.when(surface.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.array(F.to_date(F.try_to_timestamp(surface, F.lit("yyyy-MM-dd")))))
        .when(surface.rlike(r"^\d{1,2}[/.]\d{1,2}[/.]\d{4}$"), numeric)
        .otherwise(F.array(make(year, month_number(named), day)))
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def date_mentions(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(`key`, surface): each written date of each text."""
    return items.select(F.col(key), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(DATE), F.lit(0))).alias("surface"))


def temporal_relation(start: Column, end: Column, day: Column, inclusive: Column) -> Column:
    """Of a validity to a day: unknown, before, after, boundary_unresolved or within."""
    return (
        F.when(start.isNull() & end.isNull(), "unknown")
        .when(day < start, "before")
        .when(day > end, "after")
        .when((day == end) & inclusive.isNull(), "boundary_unresolved")
        .otherwise("within")
    )


def number_readings(surface: Column) -> Column:
    """All amounts a written number can mean, as text: a single separator may group thousands or begin decimals."""
    grouped = surface.rlike(r"^\d{1,3}(?:[.,' ]\d{3})+$")
    plain = F.regexp_replace(surface, r"[.,' ]", "")
    decimal = F.regexp_replace(F.regexp_replace(surface, r"[' ]", ""), ",", ".")
    both = surface.contains(".") & surface.contains(",")
    last = F.greatest(F.instr(F.reverse(surface), "."), F.instr(F.reverse(surface), ","))
    rightmost = F.least(F.when(surface.contains("."), F.instr(F.reverse(surface), ".")).otherwise(last), F.when(surface.contains(","), F.instr(F.reverse(surface), ",")).otherwise(last))
    split = F.concat(F.regexp_replace(F.left(surface, F.length(surface) - rightmost), r"[.,' ]", ""), F.lit("."), F.right(surface, rightmost - 1))
    single = F.regexp_count(surface, F.lit(r"[.,]")) == 1
    readings = F.when(both, F.array(split)).when(
        single, F.array(F.when(surface.rlike(r"^\d+[.,]\d{1,3}$"), decimal), F.when(grouped, plain))
    ).otherwise(F.array(plain))
    return F.array_sort(F.array_distinct(F.array_compact(readings)))


#: One clause with an actor, what it does to an object, and whether; the object carries a number.
CLAIM = r"^(?P<actor>[A-Z][a-z]+(?: [A-Z][a-z]+)?) (?P<verb>will approve|must approve|may approve|did not approve|approved) order (?P<object>\d+)(?: (?P<condition>only after [^.?]+|if [^.?]+))?\.$"


def claims(sentences: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(`key`, actor, entity, polarity, modality, condition): sentences that are one whole clause of the rule; a question makes no claim."""
    part = lambda i: F.regexp_extract(F.col(text), CLAIM.replace("?P<actor>", "").replace("?P<verb>", "").replace("?P<object>", "").replace("?P<condition>", ""), i)
    verb = part(2)
    modality = F.when(verb.startswith("will"), "planned").when(verb.startswith("must"), "required").when(verb.startswith("may"), "possible").otherwise("asserted")
    polarity = F.when(verb.contains("not"), "negative").otherwise("positive")
    found = sentences.filter(part(1) != "")
    return found.select(key, part(1).alias("actor"), part(3).alias("entity"), polarity.alias("polarity"), modality.alias("modality"), F.when(part(4) != "", part(4)).alias("condition"))


#: What can be done with what, by predicate: base form, past, participle; then the German participle.
VERBS = {
    "approve": ("approve", "approved", "approved", "genehmigt"),
    "sign": ("sign", "signed", "signed", "unterschrieben"),
    "pay": ("pay", "paid", "paid", "bezahlt"),
    "deliver": ("deliver", "delivered", "delivered", "geliefert"),
    "return": ("return", "returned", "returned", "zurückgegeben"),
    "cancel": ("cancel", "cancelled", "cancelled", "storniert"),
}
_ACTOR = r"([A-Z][\p{L}'-]+(?: [A-Z][\p{L}'-]+)?)"
_THING = r"(?i:(order|invoice|contract|shipment) ((?:[A-Z]+-)?\d+))"
_DING = r"(?:[Dd](?:er|ie|as|en) )?(Auftrag|Rechnung|Vertrag|Lieferung) ((?:[A-Z]+-)?\d+)"
_WHEN = r"(?: on (\d{4}-\d{2}-\d{2}))?"
_IF = r"(?:,? ((?:only after|only if|if|unless) [^.?!]+))?"
_FALLS = r"(?:,? ((?:falls|wenn|sofern|erst nachdem) [^.?!]+))?"
#: Auxiliaries with polarity, modality and the scope of the negation.
_ACTIVE = (
    ("", 1, "positive", "asserted", ""),
    ("did not ", 0, "negative", "asserted", "event"),
    ("has ", 2, "positive", "asserted", ""),
    ("has not ", 2, "negative", "asserted", "event"),
    ("will ", 0, "positive", "planned", ""),
    ("will not ", 0, "negative", "planned", "event"),
    ("must ", 0, "positive", "required", ""),
    ("must not ", 0, "negative", "prohibited", "modality"),
    ("may ", 0, "positive", "possible", ""),
    ("may not ", 0, "unresolved", "unresolved", "unresolved"),
)
_PASSIVE = (
    ("was ", "positive", "asserted", ""),
    ("was not ", "negative", "asserted", "event"),
    ("will be ", "positive", "planned", ""),
    ("will not be ", "negative", "planned", "event"),
    ("must be ", "positive", "required", ""),
    ("must not be ", "negative", "prohibited", "modality"),
    ("may be ", "positive", "possible", ""),
    ("may not be ", "unresolved", "unresolved", "unresolved"),
)
_GERMAN = (
    ("wurde", "", "positive", "asserted", ""),
    ("wurde nicht", "", "negative", "asserted", "event"),
    ("muss", " werden", "positive", "required", ""),
    ("muss nicht", " werden", "unresolved", "not_required", "modality"),
    ("darf nicht", " werden", "negative", "prohibited", "modality"),
    ("(?:kann|könnte|soll) nicht", " werden", "unresolved", "unresolved", "unresolved"),
    ("(?:kann|könnte)", " werden", "positive", "possible", ""),
    ("wird", " werden", "positive", "planned", ""),
)


def _any(form: int) -> str:
    return "(" + "|".join(v[form] for v in VERBS.values()) + ")"


def _rules() -> list[tuple]:
    """(pattern, groups of actor, verb, kind, number, day and condition (0: none), polarity, modality, scope, language), in the order they are tried."""
    out: list[tuple] = []
    for aux, form, *meaning in _ACTIVE:
        out.append((f"^{_ACTOR} {aux}{_any(form)} {_THING}{_WHEN}{_IF}\\.$", 1, 2, 3, 4, 5, 6, *meaning, "en"))
    for aux, *meaning in _PASSIVE:
        out.append((f"^(?:The )?{_THING} {aux}{_any(2)}(?: by {_ACTOR})?{_WHEN}{_IF}\\.$", 4, 3, 1, 2, 5, 6, *meaning, "en"))
    for no, polarity, scope in (("", "positive", ""), ("nicht ", "negative", "event")):
        out.append((f"^{_ACTOR} hat {_DING} {no}{_any(3)}{_FALLS}\\.$", 1, 4, 2, 3, 0, 5, polarity, "asserted", scope, "de"))
    for aux, tail, *meaning in _GERMAN:
        out.append((f"^{_DING} {aux}(?: von {_ACTOR})? {_any(3)}{tail}{_FALLS}\\.$", 3, 4, 1, 2, 0, 5, *meaning, "de"))
    return out


#: German kinds of things by their English names.
_KINDS = {"auftrag": "order", "rechnung": "invoice", "vertrag": "contract", "lieferung": "shipment"}
_RULE = ("pattern", "actor", "verb", "kind", "number", "day", "condition", "polarity", "modality", "negation_scope", "language")


def clause_claims(sentences: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(`key`, actor, predicate, entity, polarity, modality, negation_scope, condition, applicable_on, language) of sentences that are one whole clause.

    The first rule that matches the whole sentence counts. A question makes no claim, nor does one with a day that doesn't exist. What the rules
    can't settle is `unresolved`, never guessed; what isn't said is null.
    """
    c = F.col("_t")
    rules = _rules()
    first = F.coalesce(*(F.when(c.rlike(r[0]), i + 1) for i, r in enumerate(rules)))
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(_RULE, r, strict=True))) for r in rules))
    matched = sentences.select(key, F.col(text).alias("_t")).filter(~c.contains("?")).withColumn("_i", first).filter("_i IS NOT NULL")
    ruled = matched.withColumn("_r", F.element_at(table, F.col("_i")))
    # The rule is chosen once; only its own groups are then read.
    part = lambda n: F.expr(f"CASE WHEN _r.{n} > 0 THEN nullif(regexp_extract(_t, _r.pattern, _r.{n}), '') END")
    verbs = F.create_map(*(F.lit(x) for k, forms in VERBS.items() for f in dict.fromkeys(forms) for x in (f, k)))
    kinds = F.create_map(*(F.lit(x) for pair in (*_KINDS.items(), *((en, en) for en in _KINDS.values())) for x in pair))
    found = ruled.select(
        key, part("actor").alias("actor"), F.element_at(verbs, part("verb")).alias("predicate"), F.concat(F.element_at(kinds, F.lower(part("kind"))), F.lit(":"), F.upper(part("number"))).alias("entity"),
        "_r.polarity", "_r.modality", F.expr("nullif(_r.negation_scope, '')").alias("negation_scope"), part("condition").alias("condition"), part("day").alias("day"), "_r.language",
    )
    dated = found.withColumn("applicable_on", F.to_date(F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))))
    valid = dated.filter("day IS NULL OR applicable_on IS NOT NULL")
    return valid.select(key, "actor", "predicate", "entity", "polarity", "modality", "negation_scope", "condition", "applicable_on", "language")


def conflict_groups(rows: DataFrame, block: list[str], polarity: str, key: str) -> DataFrame:
    """(`block`, members, first): groups of two or more claims about the same that don't agree."""
    grouped = rows.groupBy(*block).agg(F.countDistinct(key).alias("members"), F.countDistinct(polarity).alias("_p"), F.min(key).alias("first"))
    return grouped.filter("members >= 2 AND _p >= 2").drop("_p")


def identity_pairs(records: DataFrame, key: str, name: str, strong: list[str]) -> DataFrame:
    """(left, right, status): records that share a field's value, each pair once.

    conflicting_attributes if another shared field differs, same_identified_record if the name and a strong field agree, else possible_identity.
    Records with equal fields all are put together first (`key` is the smallest), so a value that many copies share makes no pairs.
    """
    fields = [name, *strong]
    distinct = records.groupBy(*fields).agg(F.min(key).alias(key))
    blocks = distinct.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("b")).filter("b.v IS NOT NULL")
    pairs = blocks.select(F.col(key).alias("left"), "b").join(blocks.select(F.col(key).alias("right"), "b"), "b").filter(F.col("left") < F.col("right")).select("left", "right").distinct()
    a, b = distinct.select(F.col(key).alias("left"), *(F.col(f).alias(f"a_{f}") for f in fields)), distinct.select(F.col(key).alias("right"), *(F.col(f).alias(f"b_{f}") for f in fields))
    joined = pairs.join(a, "left").join(b, "right")
    same = {f: F.coalesce(F.col(f"a_{f}") == F.col(f"b_{f}"), F.lit(False)) for f in fields}
    other = F.lit(False)
    for f in fields:
        other = other | F.coalesce(F.col(f"a_{f}") != F.col(f"b_{f}"), F.lit(False))
    agreed = F.lit(False)
    for f in strong:
        agreed = agreed | same[f]
    status = F.when(other, "conflicting_attributes").when(agreed & same[name], "same_identified_record").otherwise("possible_identity")
    return joined.select("left", "right", status.alias("status"))
