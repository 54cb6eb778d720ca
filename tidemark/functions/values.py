"""Normalising a raw notification and rendering a stored value."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality names and their stored codes.
GOOD, UNCERTAIN, BAD = "Good", "Uncertain", "Bad"
GOOD_CODE, UNCERTAIN_CODE, BAD_CODE = 0, 1, 2


def numeric_value(v_num: Column, v_bool: Column) -> Column:
    """Numbers as they are, booleans as 1 / 0, everything else null."""
    return F.coalesce(v_num, v_bool.cast("double"))


def text_value(v_num: Column, v_bool: Column, v_text: Column) -> Column:
    """The text form, kept only when there is no number."""
    return F.when(numeric_value(v_num, v_bool).isNull(), v_text)


def type_name(v_num: Column, v_bool: Column, v_text: Column, data_type: Column) -> Column:
    """The run-time type, or ``Null`` when the notification carried no value."""
    empty = v_num.isNull() & v_bool.isNull() & v_text.isNull()
    return F.when(empty, F.lit("Null")).otherwise(data_type)


def status_quality(status_code: Column) -> Column:
    """The two top bits of the 32-bit status word are its severity: 00 good, 01 uncertain, 1x bad."""
    severity = F.shiftrightunsigned(status_code.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 30)
    return F.when(severity == 0, F.lit(GOOD)).when(severity >= 2, F.lit(BAD)).otherwise(F.lit(UNCERTAIN))


def quality_code(name: Column) -> Column:
    return F.when(name == GOOD, F.lit(GOOD_CODE)).when(name == BAD, F.lit(BAD_CODE)).otherwise(F.lit(UNCERTAIN_CODE))


def quality_name(code: Column) -> Column:
    return F.when(code == GOOD_CODE, F.lit(GOOD)).when(code == BAD_CODE, F.lit(BAD)).otherwise(F.lit(UNCERTAIN))


def _let(fn, **columns: Column) -> Column:
    """``fn`` of a struct of ``columns``, each computed once however often ``fn`` uses it."""
    named = F.struct(*[column.alias(name) for name, column in columns.items()])
    return F.transform(F.array(named), fn)[0]


def number_text(value: Column) -> Column:
    """A double as culture-neutral text: ``1``, ``0.25``, ``1E+16``, ``1E-05``, ``-0``, ``NaN``.

    Spark's own cast writes plain digits from 0.001 up to ten million, where only a trailing ``.0``
    has to go. Outside that range it uses an exponent, and its digits are laid out again.
    """
    plain, size = value.cast("string"), F.abs(value)
    usual = (value == 0) | ((size >= 1e-3) & (size < 1e7)) | F.isnan(value) | (size == float("inf"))
    return F.when(usual, F.regexp_replace(plain, r"\.0$", "")).otherwise(
        _let(
            lambda n: _let(_laid_out, sign=n["sign"], digits=F.regexp_replace(n["digits"], "0+$", ""), power=n["power"]),
            sign=F.regexp_extract(plain, "^-?", 0),
            digits=F.replace(F.regexp_extract(plain, r"^-?([0-9.]+)", 1), F.lit(".")),
            power=F.regexp_extract(plain, "E(.*)$", 1).cast("int"),
        )
    )


def _laid_out(n: Column) -> Column:
    """Digits d, exponent p (the number is d[0].d[1:] times 10^p): plain from p = -4 to 14."""
    digits, power, size = n["digits"], n["power"], F.length(n["digits"])
    shown = F.abs(power).cast("string")
    exponent = F.concat(
        F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), digits.substr(F.lit(2), size))).otherwise(""),
        F.when(power < 0, "E-").otherwise("E+"), F.when(F.length(shown) < 2, F.concat(F.lit("0"), shown)).otherwise(shown),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), power + 1 - size))
    middle = F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, size))
    return F.concat(
        n["sign"],
        F.when((power >= 15) | (power < -4), exponent).when(power < 0, small).when(size <= power + 1, large)
        .otherwise(middle),
    )


def display_value(value: Column, value_text: Column) -> Column:
    """What an export shows: the number, else the text, else nothing."""
    return F.coalesce(number_text(value), value_text, F.lit(""))


def csv_field(text: Column) -> Column:
    """Minimal quoting: only fields holding a comma, a quote or a line break are quoted."""
    return F.when(
        text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(text)


def csv_line(*fields: Column) -> Column:
    return F.concat_ws(",", *[csv_field(field) for field in fields])


def effective_deadband(override: Column, default: float) -> Column:
    """The tag's own deadband, else the default; zero and below mean none."""
    band = F.coalesce(override, F.lit(float(default)))
    return F.when(band > 0, band)
