"""All fields of a text at once: fee scans, rate tables, and the twelve extractors behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablarium.functions.normalize import FREE, NEGATION, normalize_date, normalize_fee_status, normalize_money, normalize_rate, parse_tr_number
from tablarium.functions.spread import spread
from tablarium.functions.text import first_match, has, let, match_spans, plain_letters, small_letters, tr_fold, tr_fold_ascii, unmarked
from tablarium.operators import extract, offers
from tablarium.operators.classify import campaign_type, reconcile

#: Triggers of fees, titles of table columns, the ends of a clause, currencies, and the parts of rate tables.
FEE_TRIGGER = "masrafsiz|ücretsiz|ucretsiz|masraf|tahsis|ücret"  # in small_letters()
ALLOCATION_TRIGGER = "(?iuU)tahsis\\s*ücret\\w*|tahsis\\s*ucret\\w*|dosya\\s*masraf\\w*|tahsis\\s*bedel\\w*"
COLUMN_TITLE = (
    "(?iuU)y[ıi]ll[ıi]k\\s+maliyet|maliyet\\s+oran|finansman\\s+tutar|taksit\\s+tutar|kâr\\s+oran|kar\\s+oran|kâr\\s+pay|kar\\s+pay|"
    "toplam\\s+geri\\s+ödeme|toplam\\s+geri\\s+odeme|ödeme\\s+plan|odeme\\s+plan"
)
CLAUSE_END = "(?<!\\d)[.;](?!\\d)|\\n"
CURRENCY = "(?iuU)tl|₺|try|türk\\s*liras[ıi]|lira"
FEE_REACH, ALLOCATION_REACH = 40, 60
#: Words of which a text has one where a pattern matches, in plain_letters(): looking for bytes takes a hundredth of a pattern's time.
TITLE_WORDS = "maliyet tutar oran pay toplam plan".split()
TERM_WORDS, AMOUNT_WORDS, MONEY_WORDS = "ay yil sene".split(), "finansman kredi tutar limit".split(), "tl ₺ try lira".split()
FEE_WORDS, ALLOCATION_WORDS = "masraf tahsis ucret".split(), "tahsis dosya".split()
REWARD_WORDS, POINT_WORDS = "hediye puan cashback iade bonus cek kazan odul".split(), "chip puan".split()
AUDIENCE_WORDS = "emekli ogrenci esnaf kamu kobi serbest maas mevcut halihaz musteri yeni ilk hos".split()
CONDITION_WORDS = "sart kosul gerek zorunlu asgari minimum yalniz sadece haric gecerli az".split()
TABLE_TITLE = "(?iuU)vade[^%\\d]{0,40}?(?:kâr|kar)\\s*(?:pay[ıi]\\s*|payla[şs][ıi]m\\s*)?oran[ıi]"
PERCENT = "(?:%\\s*\\d{1,3}[.,]\\d{1,2}|\\d{1,3}[.,]\\d{1,2}\\s*%)"
TABLE_ROW = f"\\b\\d{{1,3}}(?![\\d.,])\\s+(?:{PERCENT}\\s*){{2,5}}"
TABLE_TERM = "(?iu)\\b\\d{1,3}(?![\\d.,])\\s*(?:ay\\b)?"
TABLE_BEGUN = "^[^\\d]*+\\d[^%]*+%"  # a row is a number with a percentage after it
OF_VALUE = "(?iu)de[ğg]er\\s*[x×]\\s*$"
#: The part of a table's title that its values are shown by.
TABLE_SHOWN = "(?iuU)vade[^%\\d]{0,40}?(?:kâr|kar)\\s*pay[ıi]\\s*oran[ıi]"
WINDOW = 40
TABLE_REACH, RATE_REACH, ALLOCATION_COLUMN_REACH = 4000, 60, 30
MAX_TERM, MAX_RATE, MAX_ALLOCATION_RATE = 480, 15, 10
FIELDS = (
    "kar_payi_orani vade_ay finansman_tutari taksit_sayisi masraf_durumu tahsis_ucreti kampanya_suresi odul_miktari indirim_orani alisveris_puani hedef_kitle kampanya_kosullari"
).split()

_PARTS = {
    "num": "double", "min": "double", "max": "double", "value": "double", "currency": "string", "has_fee": "boolean", "amount": "double",
    "rate": "double", "day": "date", "kind": "string", "items": "array<string>", "s": "int", "e": "int", "raw": "string", "window": "string", "confidence": "double",
}
_ROW = "struct<term:int,rate:double,fee:double>"


def made(name: str, when: Column, **parts: Column) -> Column:
    """A field as a struct of its name and all parts of canonical values, or null unless `when` holds."""
    return F.when(when, F.struct(F.lit(name).alias("field"), *[parts.get(k, F.lit(None)).cast(t).alias(k) for k, t in _PARTS.items()]))


def shown(name: str, text: Column, value: Column, evidence: Column) -> Column:
    """A field of made(), of this name, with its evidence (see extract.at): offsets, the raw text there, the window around it, confidence; null stays null."""

    def parts(v: Column, a: Column) -> Column:
        numbers = F.array_compact(F.array(*[v[p] for p in ("num", "value", "amount", "min", "max")]))
        start = F.greatest(a["ws"] - WINDOW, F.lit(0))
        score = offers.confidence(F.lit(name), numbers, a["distance"], F.coalesce(a["candidates"], F.lit(1)), v["min"].isNotNull() & v["max"].isNotNull())
        own = {
            "s": a["s"], "e": a["e"], "raw": F.coalesce(F.substring(text, a["s"] + 1, a["e"] - a["s"]), F.get(v["items"], F.lit(0))),
            "window": F.btrim(F.substring(text, start + 1, a["we"] + WINDOW - start), F.lit(" \t\n\r\x0b\x0c\xa0")), "confidence": score,
        }
        return F.struct(v["field"].alias("field"), *[own.get(k, v[k]).cast(t).alias(k) for k, t in _PARTS.items()])

    # most fields are missing in most texts, and are then not looked for again
    return let(value, lambda v: F.when(v.isNotNull(), let(evidence, lambda a: parts(v, a))))


def _clause(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] up to the end of its clause."""
    return F.regexp_replace(F.substring(text, start + 1, end - start), f"(?s)(?:{CLAUSE_END}).*", "")


def _best(found: Column, good) -> Column:
    """The first item for which good holds, else the first one."""
    return let(found, lambda f: F.coalesce(F.get(F.filter(f, good), F.lit(0)), F.get(f, F.lit(0))))


def fee_claim(text: Column, low: Column | None = None, folded: Column | None = None) -> Column:
    """Struct has_fee, amount, s, e. Of all mentions a denial wins wherever it stands, else the first fee.

    A mention's fee stands within 40 characters, in its clause, before the next column of a table. low is tr_fold(text) and folded tr_fold_ascii(text), if they are known.
    """

    def one(t: Column, folded: Column):
        def read(m: Column) -> Column:
            same = lambda c: F.substring(folded, m["s"] + 1, F.length(c))  # noqa: E731, folding keeps places
            before = lambda c: F.when(has(plain_letters(same(c)), *TITLE_WORDS), F.regexp_replace(c, f"(?s)(?:{COLUMN_TITLE}).*", "")).otherwise(c)
            known = let(let(_clause(t, m["s"], m["e"] + FEE_REACH), before), lambda c: normalize_fee_status(c, same(c)))
            claim = lambda has_fee, value: F.struct(has_fee.alias("has_fee"), value.alias("amount"), m["s"].alias("s"), m["e"].alias("e"))
            denied = same(m["m"]).isin([w for w in FREE if " " not in w])  # a mention that is a denial needs no clause
            return F.when(denied, claim(F.lit(False), F.lit(0.0))).otherwise(let(known, lambda f: F.when(f.isNotNull(), claim(f["has_fee"], f["amount"]))))

        return read

    known = lambda t, low, plain: F.array_compact(F.transform(match_spans(small_letters(low), FEE_TRIGGER), one(t, plain)))
    found = let(text, lambda t: let(tr_fold(t) if low is None else low, lambda x: let(unmarked(x) if folded is None else folded, lambda y: known(t, x, y))))
    return _best(found, lambda f: ~f["has_fee"])


def allocation_fee(text: Column) -> Column:
    """Struct value, currency, s, e, t (end of the trigger). Of all mentions the first positive fee wins, else a denial, which is 0; a fee needs its currency."""

    def one(t: Column):
        def read(m: Column) -> Column:
            def typed(c: Column) -> Column:
                money = F.when(c.rlike(CURRENCY), normalize_money(c))
                fee = F.when(tr_fold_ascii(c).rlike(NEGATION), F.struct(F.lit(0.0).alias("value"), F.lit("TRY").alias("currency"))).otherwise(money)
                end = (m["e"] + F.length(c)).alias("e")
                return let(fee, lambda f: F.when(f.isNotNull(), F.struct(f["value"].alias("value"), f["currency"].alias("currency"), m["s"].alias("s"), end, m["e"].alias("t"))))

            return let(_clause(t, m["e"], m["e"] + ALLOCATION_REACH), typed)

        return read

    known = lambda t: F.array_compact(F.transform(match_spans(t, ALLOCATION_TRIGGER), one(t)))
    return _best(let(text, known), lambda f: f["value"] > 0)


def rate_table(text: Column) -> Column:
    """array<struct<term, rate, fee>> of the rows below a title of terms and rates; empty without one.

    Rows of a term and two to five percentages count first. Else each term takes the next rate that isn't taken, within 60 characters.
    """
    tail = let(first_match(text, TABLE_TITLE), lambda m: F.substring(text, m["e"] + 1, F.lit(TABLE_REACH)))
    rows = lambda t: let(_plain_rows(t), lambda rows: F.when(F.size(rows) > 0, rows).otherwise(_loose_rows(t)))
    return let(tail, lambda t: F.when(t.rlike(TABLE_BEGUN), rows(t)).otherwise(F.array().cast(f"array<{_ROW}>")))


def _row(term: Column, rate: Column, fee: Column) -> Column:
    good = term.between(1, MAX_TERM) & (rate > 0) & (rate <= MAX_RATE)
    return F.when(good, F.struct(term.alias("term"), rate.alias("rate"), F.when(fee.between(0, MAX_ALLOCATION_RATE), fee).alias("fee")))


def _plain_rows(tail: Column) -> Column:
    def read(row: Column) -> Column:
        rates = F.transform(F.regexp_extract_all(row, F.lit(PERCENT), F.lit(0)), parse_tr_number)
        return let(rates, lambda r: _row(F.regexp_extract(row, "^\\d+", 0).cast("int"), F.get(r, F.lit(0)), F.get(r, F.lit(1))))

    rows = F.array_compact(F.transform(F.regexp_extract_all(tail, F.lit(TABLE_ROW), F.lit(0)), read))
    return F.when(tail.rlike("%[^%]*%"), rows).otherwise(F.array().cast(f"array<{_ROW}>"))


def _loose_rows(tail: Column) -> Column:
    def pair(t: Column, percents: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            free = F.filter(percents, lambda p: (p["s"] >= m["e"]) & (p["s"] - m["e"] <= RATE_REACH) & ~F.array_contains(acc["used"], p["s"]))

            def take(p: Column) -> Column:
                after = F.get(F.filter(percents, lambda x: (x["s"] >= p["e"]) & (x["s"] - p["e"] <= ALLOCATION_COLUMN_REACH)), F.lit(0))
                before = F.greatest(p["s"] - 12, F.lit(0))
                of_value = F.substring(t, before + 1, p["s"] - before).rlike(OF_VALUE)
                row = _row(F.regexp_extract(m["m"], "\\d+", 0).cast("int"), parse_tr_number(p["m"]), parse_tr_number(after["m"]))
                new = let(F.when(p.isNotNull() & ~of_value, row), lambda r: F.struct(
                    F.when(r.isNotNull(), F.concat(acc["used"], F.array(p["s"]))).otherwise(acc["used"]).alias("used"),
                    F.when(r.isNotNull(), F.concat(acc["rows"], F.array(r))).otherwise(acc["rows"]).alias("rows"),
                ))
                return new

            return let(F.get(free, F.lit(0)), take)

        begin = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{_ROW}>").alias("rows"))
        return F.aggregate(match_spans(t, TABLE_TERM), begin, step, lambda acc: acc["rows"])

    return let(match_spans(tail, PERCENT), lambda p: F.when(F.size(p) > 0, pair(tail, p)).otherwise(F.array().cast(f"array<{_ROW}>")))


def from_rate_table(rows: Column) -> Column:
    """X11: struct num, min, max (of the rates), term (the longest), fee (if the table has one only); null without rows."""

    def sums(r: Column) -> Column:
        rates, fees = F.transform(r, lambda x: x["rate"]), F.array_distinct(F.array_compact(F.transform(r, lambda x: x["fee"])))
        low, high = F.array_min(rates), F.array_max(rates)
        return F.when(F.size(r) > 0, F.struct(
            F.when(low == high, low).alias("num"), F.when(low < high, low).alias("min"), F.when(low < high, high).alias("max"),
            F.array_max(F.transform(r, lambda x: x["term"])).alias("term"), F.when(F.size(fees) == 1, F.get(fees, F.lit(0))).alias("fee"),
        ))

    return let(rows, sums)


def _table(text: Column, plain: Column) -> Column:
    return F.when(has(plain, "vade") & has(plain, "oran"), from_rate_table(rate_table(text)))


def _found(t: Column, low: Column, folded: Column, plain: Column, table: Column, evidence: bool) -> list[Column]:
    """The twelve fields of a text, or nulls. low is its tr_fold(), folded its tr_fold_ascii(), plain that in plain_letters(), table its _table()."""
    at = extract.at
    show = shown if evidence else lambda _name, _text, value, _at: value
    has_table = table.isNotNull()
    near = lambda value, *words: F.when(has(plain, *words), value)  # noqa: E731, nothing is looked for in a text that has none of its words
    whole = lambda c: F.nullif(c, F.lit(""))
    title = let(first_match(t, TABLE_SHOWN), lambda m: at(F.coalesce(m["s"], F.lit(0)), F.coalesce(m["e"], F.lit(0))))
    money = lambda name: lambda v: made(name, v.isNotNull(), value=v["value"], currency=v["currency"])
    wide = lambda name: lambda v: made(name, v.isNotNull(), num=v["num"], min=v["min"], max=v["max"])
    number = lambda name, v: made(name, v.isNotNull(), num=v)
    rate, term, amount, count, fee, allocation, day, reward, discount, points, audience, conditions = FIELDS
    table_rate = show(rate, t, wide(rate)(table), title)
    sharing = F.when(has(plain, "paylas"), t.rlike(extract.SHARING)).otherwise(False)
    one_rate = let(F.when(~sharing, extract.rate_found(t)), lambda x: F.when(x.isNotNull(), show(rate, t, let(normalize_rate(x["raw"]), wide(rate)), x["at"])))
    one_term = let(extract.term(t, low, evidence), lambda v: show(term, t, number(term, v["months"]), at(v["s"], v["e"], distance=v["d"], candidates=v["n"])))
    one_amount = let(first_match(t, extract.AMOUNT, 1, 2), lambda m: F.when(m.isNotNull(), show(amount, t, let(normalize_money(m["g2"]), money(amount)), extract.amount_at(m))))
    one_count = let(first_match(t, extract.INSTALMENTS, 1, 2), lambda m: show(count, t, number(count, F.coalesce(whole(m["g1"]), whole(m["g2"])).cast("int")), extract.whole_at(m)))
    one_fee = let(fee_claim(t, low, folded), lambda v: show(fee, t, made(fee, v.isNotNull(), has_fee=v["has_fee"], amount=v["amount"]), at(v["s"], v["e"])))
    one_allocation = let(allocation_fee(t), lambda v: show(allocation, t, money(allocation)(v), at(v["s"], v["e"], v["s"], v["t"])))
    one_day = let(first_match(t, extract.DEADLINE), lambda m: show(day, t, let(normalize_date(m["m"]), lambda v: made(day, v.isNotNull(), day=v)), extract.deadline_at(t, m)))
    one_reward = let(offers.rewarded(t), lambda x: show(reward, t, let(normalize_money(x["m"]), money(reward)), at(x["at"], x["to"], distance=x["d"])))
    return [
        F.when(has_table, table_rate).otherwise(near(one_rate, "pay")),
        F.when(has_table, show(term, t, made(term, F.lit(True), num=table["term"]), title)).otherwise(near(one_term, *TERM_WORDS)),
        F.when(has(plain, *MONEY_WORDS), near(one_amount, *AMOUNT_WORDS)),
        near(one_count, "taksit"),
        near(one_fee, *FEE_WORDS),
        F.when(table["fee"].isNotNull(), show(allocation, t, made(allocation, F.lit(True), rate=table["fee"]), title)).otherwise(near(one_allocation, *ALLOCATION_WORDS)),
        F.when(t.rlike("(?U)\\d{4}"), one_day),
        F.when(has(plain, *MONEY_WORDS), near(one_reward, *REWARD_WORDS)),
        F.when(t.contains("%"), near(show(discount, t, let(extract.discount(t), wide(discount)), extract.discount_at(t)), "indirim")),
        near(show(points, t, let(offers.points(t), lambda v: made(points, v.isNotNull(), kind=v["kind"], value=v["value"])), offers.points_at(t)), *POINT_WORDS),
        near(show(audience, t, let(offers.audience(t), lambda v: made(audience, v.isNotNull(), items=v)), offers.audience_at(t)), *AUDIENCE_WORDS),
        near(let(offers.conditions(t), lambda v: show(conditions, t, made(conditions, v.isNotNull(), items=v), offers.conditions_at(t, F.get(v, F.lit(0))))), *CONDITION_WORDS),
    ]


def extract_all(text: Column, evidence: bool = True) -> Column:
    """Array of structs, one for each field found: its name, the parts of its canonical value, where it stands (s, e: code points),
    the raw text there, the window around it and the confidence. A rate table comes before single mentions.

    Without evidence the last five parts are null, for those that only ask what was found.
    """

    def known(t: Column) -> Column:
        found = lambda low, folded, plain: let(_table(t, plain), lambda table: F.array_compact(F.array(*_found(t, low, folded, plain, table, evidence))))
        return let(tr_fold(t), lambda low: let(unmarked(low), lambda folded: let(plain_letters(folded), lambda plain: found(low, folded, plain))))

    return let(F.coalesce(text, F.lit("")), known)


def field(found: Column, name: str) -> Column:
    """One field of extract_all(), or null."""
    return F.get(F.filter(found, lambda f: f["field"] == name), F.lit(0))


def campaigns(docs: DataFrame, text: str = "text", evidence: bool = True) -> DataFrame:
    """Docs with type, type_confidence and fields (see extract_all).

    What extract_all() binds by let() are columns of their own here, as Spark compiles what stands in columns, but walks through what stands in a fold.
    """
    kind = campaign_type(F.coalesce(F.col(text), F.lit("")))
    names = ["_text", "_low", "_folded", "_plain", "_table"]
    t, low, folded, plain, table = map(F.col, names)
    df = spread(docs).withColumn("kind", kind)
    for name, value in zip(names, (F.coalesce(F.col(text), F.lit("")), tr_fold(t), unmarked(low), plain_letters(folded), _table(t, plain)), strict=True):
        df = df.withColumn(name, value)
    df = df.withColumns({f"_{name}": c for name, c in zip(FIELDS, _found(t, low, folded, plain, table, evidence), strict=True)})
    none = F.array().cast(df.select(F.array(f"_{FIELDS[0]}")).schema[0].dataType)
    # each column stands here twice, so that Spark leaves it a column
    fields = F.concat(*[F.when(F.col(f"_{name}").isNotNull(), F.array(f"_{name}")).otherwise(none) for name in FIELDS])
    return df.select(*docs.columns, F.col("kind.type").alias("type"), F.col("kind.confidence").alias("type_confidence"), fields.alias("fields"))


def long_fields(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each field of campaigns(): keys and the field's parts.

    Of explode() Spark infers a filter on the array's size, which it computes a second time, before the rows are dealt to all cores.
    """
    return docs.select(*keys, F.explode_outer("fields").alias("f")).filter("f is not null").select(*keys, "f.*")


def merge_layers(rules: DataFrame, model: DataFrame, keys: list[str], verify_below: float | None = None) -> DataFrame:
    """Rows of both layers (keys, field, confidence, extractor, seq), one for each keys and field.

    Without verify_below the model only fills fields that the rules lack. With it, it also competes by confidence with rules below it.
    """
    strong = rules if verify_below is None else rules.filter(F.col("confidence") >= verify_below)
    open_ = model.join(strong.select(*keys, "field"), [*keys, "field"], "left_anti")
    return reconcile(rules.unionByName(open_), [*keys, "field"], by_confidence=verify_below is not None)
