"""Typed values from raw text: one struct with the first reading that fits, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: units with a multiplier, words for true and false, quantifiers, numerals
MULTIPLIERS = {
    "元": 1, "美元": 1, "USD": 1, "$": 1, "万": 10000, "万元": 10000, "亿": 100000000, "亿元": 100000000, "克": 0.001, "g": 0.001, "kg": 1, "公斤": 1, "千克": 1, "吨": 1000,
    "米": 1, "m": 1, "公里": 1000, "km": 1000, "厘米": 0.01, "cm": 0.01, "秒": 1, "s": 1, "分钟": 60, "小时": 3600, "天": 86400,
}
TRUE_WORDS = ("是", "对", "真", "yes", "true", "已", "有", "启用", "开启")
FALSE_WORDS = ("否", "错", "假", "no", "false", "未", "无", "禁用", "关闭")
QUANTIFIERS = ("个", "件", "条", "项", "批", "次", "笔", "单", "组")
DIGITS = "零一二三四五六七八九"
PLACES = {"十": 10, "百": 100, "千": 1000, "万": 10000, "亿": 100000000, "兆": 1000000000000}
KINDS = "struct<type:string,raw:string,number:double,moment:timestamp,flag:boolean,label:string,unit:string,confidence:double>"


def _value(kind: Column | str, raw: Column, confidence: Column | float, **parts: Column) -> Column:
    field = lambda name, t: parts.get(name, F.lit(None)).cast(t).alias(name)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(kind.alias("type"), raw.alias("raw"), field("number", "double"), field("moment", "timestamp"), field("flag", "boolean"), field("label", "string"), field("unit", "string"), confidence.cast("double").alias("confidence"))


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(float(v) if isinstance(v, float) else v) for p in pairs.items() for v in p])


def _numeral(digits: Column, unit: Column, raw: Column, factor: Column, force: str | None, inner_kind: Column | None = None) -> Column:
    """digits with commas to a value; force int refuses points and exponents, force float always gives a float."""
    plain = F.replace(digits, F.lit(","), F.lit(""))
    number, whole = plain.try_cast("double") * factor, ~plain.rlike("[.eE]")
    if force == "int":
        return F.when(number.isNotNull() & whole, _value("int", raw, 0.95, number=F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)), unit=unit))
    if force == "float":
        return F.when(number.isNotNull(), _value("float", raw, 0.95, number=number, unit=unit))
    kind = inner_kind if inner_kind is not None else F.when(number == F.floor(number), "int").otherwise("float")
    return F.when(number.isNotNull(), _value(kind, raw, 0.95, number=number, unit=unit))


def parse_number(x: Column, force: str | None = None, unit: str | None = None) -> Column:
    """Digits with separators, an exponent and an optional unit, whose multiplier applies; else a Chinese numeral.

    unit: a configured unit, tried first (see parse_with_unit). force: int or float, for strict types.
    """
    x = F.trim(x)
    pattern = r"^([0-9,.]+(?:[eE][+-]?[0-9]+)?)\s*([a-zA-Z一-龥]*)$"
    digits, found = F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)
    factor = F.coalesce(F.element_at(_literal_map({k: float(v) for k, v in MULTIPLIERS.items()}), found), F.lit(1.0))
    plain = _numeral(digits, F.nullif(found, F.lit("")), x, factor, force)
    numeral = parse_chinese_number(x)
    if force == "float":
        numeral = F.when(numeral.isNotNull(), _value("float", x, 0.85, number=numeral["number"]))
    # an integer that is forced and refused stays refused
    rest = F.when(digits == "", numeral) if force == "int" else numeral
    readings = [parse_with_unit(x, unit, force)] if unit else []
    return F.coalesce(*readings, plain, rest)


def parse_with_unit(x: Column, unit: str, force: str | None = None) -> Column:
    """A number or Chinese numeral, perhaps a quantifier, and the configured unit; the unit multiplies nothing."""
    x = F.trim(x)
    tail = f"(?:{'|'.join(QUANTIFIERS)})?\\Q{unit}\\E$"
    digits = F.regexp_extract(x, r"(?i)^([0-9,.]+(?:e[+-]?[0-9]+)?)" + tail, 1)
    kind = F.when(digits.rlike("[.eE]"), "float").otherwise("int")
    plain = _numeral(digits, F.lit(unit), x, F.lit(1.0), force, kind)
    numeral = parse_chinese_number(F.regexp_extract(x, f"^([{DIGITS[1:]}{''.join(PLACES)}]+)" + tail, 1), most=10**6)
    return F.coalesce(plain, F.when(numeral.isNotNull(), _value("float" if force == "float" else "int", x, 0.90, number=numeral["number"], unit=F.lit(unit))))


def parse_chinese_number(x: Column, parity: bool = True, most: int = 6) -> Column:
    """Numerals of up to ``most`` signs, read from the right.

    parity: as the reference reads them, where a smaller place multiplies what was read and a bare place counts nothing.
    Otherwise as they are meant: 十 is 10, and 万, 亿 and 兆 raise all places before them.
    """
    signs = F.reverse(F.filter(F.split(F.trim(x), ""), lambda c: c != ""))
    place, digits = _literal_map(PLACES), _literal_map({c: i for i, c in enumerate(DIGITS)})
    long = lambda v: F.lit(v).cast("long")
    state = F.struct(long(0).alias("total"), long(1).alias("unit"), long(1).alias("base"), F.lit(False).alias("open"))

    def read(s, c):
        p, digit = F.element_at(place, c).cast("long"), F.coalesce(F.element_at(digits, c), F.lit(0)).cast("long")
        if parity:
            base, unit = s["base"], F.when(p > s["unit"], p).otherwise(s["unit"] * p)
        else:
            base = F.when(p < 10000, s["base"]).when(p > s["base"], p).otherwise(s["base"] * p)
            unit = F.when(p < 10000, s["base"] * p).otherwise(base)
        return F.when(p.isNotNull(), F.struct(s["total"].alias("total"), unit.alias("unit"), base.alias("base"), F.lit(True).alias("open"))).otherwise(
            F.struct((s["total"] + digit * s["unit"]).alias("total"), s["unit"].alias("unit"), s["base"].alias("base"), F.lit(False).alias("open"))
        )

    end = F.aggregate(signs, state, read)
    total = end["total"] if parity else end["total"] + F.when(end["open"], end["unit"]).otherwise(0)
    known = DIGITS[1:] if parity else DIGITS
    fits = F.trim(x).rlike(f"^[{known}{''.join(PLACES)}]{{1,{min(most, 1000)}}}$") & (total > 0)
    return F.when(fits, _value("int", F.trim(x), 0.85, number=total))


# fixed values: signs of an amount, which keep a leading year from being read as a date
MONEY = ("元", "美元", "USD", r"\$", "¥", "万元", "亿元", "块", "角", "分", "块钱", "毛", "EUR", "£", "RMB", "CNY", "HKD", "/月", "/年", "/天", "/周", "每月", "每年", "起", "左右", "约")


def parse_datetime(x: Column) -> Column:
    """The first date anywhere in the text, with 年月日 or dashes; the most precise form that is a real date wins.

    A year alone counts at the beginning only, from 1970 to 2099, and not beside a sign of an amount.
    """
    day = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    forms = [
        (rf"(?U){day}[\sT]+(\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}})", 6, 0.98), (rf"(?U){day}[\sT]+(\d{{1,2}}):(\d{{1,2}})", 5, 0.95),
        (day, 3, 0.98), (r"(\d{4})-(\d{1,2})(?:[^\d]|$)", 2, 0.90), (r"^(\d{4})(?:[^\d]|$)", 1, 0.85),
    ]

    def read(s: Column) -> Column:
        found = []
        for p, n, confidence in forms:
            part = [F.nullif(F.regexp_extract(s["clean"], p, i + 1), F.lit("")).try_cast("int") for i in range(n)] + [F.lit(x) for x in (1, 1, 0, 0, 0)[n - 1 :]]
            fits = (part[0] >= 1) & (part[5] < 60)
            if n == 1:
                fits = part[0].between(1970, 2099) & ~s["raw"].rlike(f"(?i){'|'.join(MONEY)}")
            moment = F.when(fits & s["clean"].rlike(p), F.try_make_timestamp(*part))
            found.append(F.when(moment.isNotNull(), F.struct(moment.alias("moment"), F.lit(confidence).alias("confidence"))))
        return F.struct(s["raw"].alias("raw"), F.coalesce(*found).alias("found"))

    clean = F.regexp_replace(F.regexp_replace(F.translate(F.trim(x), "年月日", "--"), "-+", "-"), "^-|-$", "")
    # read inside a lambda: the expressions are many, and this way they are evaluated, not repeated in generated code
    got = F.element_at(F.transform(F.array(F.struct(F.trim(x).alias("raw"), clean.alias("clean"))), read), 1)
    return F.element_at(
        F.transform(F.array(got), lambda g: F.when(g["found"].isNotNull(), _value("datetime", g["raw"], g["found"]["confidence"], moment=g["found"]["moment"]))), 1
    )


def parse_compact_datetime(x: Column) -> Column:
    """14, 12, 8 or 6 digits."""
    raw, found = F.trim(x), []
    for n, form, confidence in ((14, "yyyyMMddHHmmss", 0.95), (12, "yyyyMMddHHmm", 0.92), (8, "yyyyMMdd", 0.95), (6, "yyyyMM", 0.90)):
        moment = F.try_to_timestamp(F.when(raw.rlike(f"^[0-9]{{{n}}}$"), raw), F.lit(form))
        found.append(F.when(F.year(moment).between(1970, 2099), _value("datetime", raw, confidence, moment=moment)))
    return F.coalesce(*found)


def parse_bool(x: Column) -> Column:
    low = F.lower(F.trim(x))
    known = (F.length(low) <= 10) & low.isin(*TRUE_WORDS, *FALSE_WORDS)
    return F.when(known, _value("bool", F.trim(x), 0.95, flag=low.isin(*TRUE_WORDS)))


def parse_enum(x: Column, labels: list[str]) -> Column:
    """Exact label 1.0; the first label that holds the text or is held by it, in any case, 0.8; else UNKNOWN 0.0."""
    raw = F.trim(x)
    low = F.lower(raw)
    near = F.filter(F.array(*map(F.lit, labels)), lambda label: low.contains(F.lower(label)) | F.lower(label).contains(low))
    return F.when(raw.isin(*labels), _value("enum", raw, 1.0, label=raw)).when(F.size(near) > 0, _value("enum", raw, 0.8, label=F.element_at(near, 1))).otherwise(_value("enum", raw, 0.0, label=F.lit("UNKNOWN")))


def parse_text(x: Column) -> Column:
    return _value("text", F.trim(x), 1.0, label=F.trim(x))


def parse_value(x: Column, timed: bool = False, labels: list[str] | None = None, unit: str | None = None) -> Column:
    """The first reading: compact date (timed types), datetime, number, Chinese number, enum (if given), bool, text. Blank: null."""
    readings = [parse_compact_datetime(x)] if timed else []
    readings += [parse_datetime(x), parse_number(x, unit=unit)]
    readings += [parse_enum(x, labels)] if labels else []
    return F.when(F.trim(x) != "", F.coalesce(*readings, parse_bool(x), parse_text(x)))


def parse_strict(x: Column, kind: str, labels: list[str] | None = None, unit: str | None = None) -> Column:
    """Only the reading that a constraint names; null if it doesn't fit, or if an enum has no labels."""
    if kind in ("int", "float"):
        reading = parse_number(x, kind, unit)
    elif kind == "datetime":
        reading = F.coalesce(parse_compact_datetime(x), parse_datetime(x))
    else:
        reading = {"bool": lambda: parse_bool(x), "text": lambda: parse_text(x), "enum": lambda: parse_enum(x, labels) if labels else F.lit(None).cast(KINDS)}[kind]()
    return F.when(F.trim(x) != "", reading)


def stated_raw(name: Column, value: Column, unit: Column, kind: Column) -> Column:
    """The raw text of a value that a model has stated: what the name doesn't say yet is added."""
    name, unit = F.coalesce(name, F.lit("")), F.coalesce(unit, F.lit(""))
    joined = F.concat(name, value)
    dated = name.rlike(r"\d{4}年|\d{1,2}月|\d{1,2}日|\d{1,2}[:：点]|\d{4}-")
    with_unit = lambda c: F.when((unit != "") & ~c.contains(unit), F.concat(c, unit)).otherwise(c)
    return (
        F.when((kind == "text") | (F.coalesce(value, F.lit("")) == ""), name).when(kind == "datetime", F.when(dated, name).otherwise(joined))
        .when(name.rlike(r"\d"), with_unit(name)).otherwise(with_unit(joined))
    )


def stated_or_parsed(name: Column, kind: Column, value: Column, unit: Column, labels: list[str] | None = None) -> list[Column]:
    """Typed columns: a valid type that a model states comes first (confidence 0.90), else the name is parsed. ``value_source`` says which.

    A stated number is read as a number before it is read as anything else, so 1970 to 2099 are no years then.
    """
    stated = F.coalesce(kind.isin("text", "int", "float", "datetime", "bool", "enum"), F.lit(False))
    read = parse_value(F.when(stated, value).otherwise(name), labels=labels)
    read = F.coalesce(F.when(kind.isin("int", "float") & (F.trim(value) != ""), parse_number(value)), read)
    out = {c: typed for c, typed in zip(TYPED, typed_columns(read))}
    out["value_type"] = F.when(stated, kind).otherwise(out["value_type"])
    out["value_raw"] = F.when(stated, stated_raw(name, value, unit, kind)).otherwise(out["value_raw"])
    out["value_unit"] = F.coalesce(F.when(stated, F.nullif(unit, F.lit(""))), out["value_unit"])
    out["value_confidence"] = F.when(stated, F.lit("0.90").cast("decimal(5,4)")).otherwise(out["value_confidence"])
    return [*(c.alias(n) for n, c in out.items()), F.when(stated, "llm").otherwise("code").alias("value_source")]


#: The names of typed_columns, in order.
TYPED = ("value_type", "value_raw", "int_value", "float_value", "datetime_value", "bool_value", "enum_value", "value_unit", "value_confidence")


def typed_columns(value: Column) -> list[Column]:
    """The struct spread to the typed columns of an entity."""
    return [
        value["type"].alias("value_type"), value["raw"].alias("value_raw"), F.when(value["type"] == "int", value["number"]).cast("long").alias("int_value"),
        F.when(value["type"] == "float", value["number"]).cast("decimal(20,4)").alias("float_value"), value["moment"].alias("datetime_value"), value["flag"].alias("bool_value"),
        F.when(value["type"] == "enum", value["label"]).alias("enum_value"), value["unit"].alias("value_unit"), value["confidence"].cast("decimal(5,4)").alias("value_confidence"),
    ]


def typed_text(value: Column) -> Column:
    """The typed value as text, by its type."""
    return F.coalesce(F.when(value["type"] == "int", value["number"].cast("long").cast("string")), value["number"].cast("string"), F.date_format(value["moment"], "yyyy-MM-dd HH:mm:ss"), value["flag"].cast("string"), value["label"])
