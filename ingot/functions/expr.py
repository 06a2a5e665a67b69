"""Scalar Column builders.

Raw records are schema-free JSON, so the fields a silver table reads are
VARIANT values. The functions here give Python's truthiness, ``str()`` and
lenient ``int()``/``float()`` semantics to VARIANT values, built only from
Spark built-ins so they stay inside whole-stage codegen.

Conventions
-----------
* ``v_*`` functions take VARIANT Columns, ``s_*`` functions take string Columns.
* A *field accessor* is a callable ``name -> VARIANT Column``. Two are provided:
  :func:`json_fields` reads fields of a parsed JSON record, :func:`column_fields`
  exposes typed columns of a DataFrame as VARIANT (same semantics, and filters on
  them still push below aggregates and joins).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FieldAccessor = Callable[[str], "Field"]

# str() renderings that are falsy unless the value was a JSON string (fixed values).
_AMBIGUOUS_TEXT = ("false", "[]", "{}")

# Java reads "1d" and "2f" as numbers; Python's float() doesn't (fixed pattern).
_JAVA_SUFFIX = r"(?i)[0-9.][df]\s*$"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _no_suffix(number: Column, text: Column) -> Column:
    """``number`` unless its text is a number only to Java."""
    return F.when(~text.rlike(_JAVA_SUFFIX), number)


def _whole(text: Column, value: Column) -> Column:
    """``value``, a JSON value's lenient int, where its text doesn't say it: a cast of a value costs much, a failed one an exception."""
    first = F.substring(text, 1, 1)
    word = (first.between("A", "Z") | first.between("a", "z")) & ~text.isin("true", "false")  # no number begins so
    digits = text.rlike("^[+-]?[0-9]{1,18}$")
    return F.when(text.isNotNull() & ~word, F.when(digits, text.try_cast("bigint")).otherwise(value))


class Field:
    """One field of a raw record, with Python's view of it.

    ``raw`` is the field's Column; ``kind`` says how to read it: ``"json"`` for
    a VARIANT value of unknown JSON type, else the Spark type of a typed column.
    ``text``/``falsy`` take the staged columns (see :func:`stage_fields`) so the
    expensive parts are evaluated once per row. ``read`` gives a JSON field's value as a Spark type straight from the
    record: a value that is made a VARIANT of its own first, and cast then, costs several times that.
    """

    def __init__(self, raw: Column, kind: T.DataType | str, read: Callable[[str], Column | None] | None = None):
        self.raw = raw
        self.kind = kind
        self.read = read

    def _known(self, typ: str, raw: Column | None) -> Column | None:
        return self.read(typ) if raw is None and self.read else None

    def _json_as(self, typ: str, raw: Column | None) -> Column:
        found = self._known(typ, raw)
        return F.try_variant_get(self.raw if raw is None else raw, "$", typ) if found is None else found

    @property
    def is_json(self) -> bool:
        return self.kind == "json"

    def text(self, raw: Column | None = None) -> Column:
        """``str(x)``, NULL when the value is None."""
        r = self.raw if raw is None else raw
        k = self.kind
        if k == "json":
            return self._json_as("string", raw)
        if isinstance(k, T.StringType):
            return r
        if isinstance(k, T.BooleanType):
            return F.when(r, F.lit("True")).when(~r, F.lit("False"))
        if isinstance(k, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(r)
        if isinstance(k, T.NullType):
            return F.lit(None).cast("string")
        return r.cast("string")

    def falsy(self, raw: Column | None = None, text: Column | None = None) -> Column:
        """Python falsiness; never NULL."""
        r = self.raw if raw is None else raw
        k = self.kind
        if k == "json":
            t = self.text(r) if text is None else text
            # a JSON number that is zero is rendered as 0..., or -0...; other texts aren't cast, as each failed cast costs an exception
            zero = F.when(t.startswith("0") | t.startswith("-0"), F.coalesce(t.try_cast("double") == F.lit(0.0), F.lit(False)))
            candidate = t.isin(*_AMBIGUOUS_TEXT) | F.coalesce(zero, F.lit(False))
            # of the ambiguous renderings ("0" vs 0) those of strings are true; of all JSON values only strings are read as bytes
            return t.isNull() | (t == F.lit("")) | (candidate & self._json_as("binary", raw).isNull())
        if isinstance(k, T.StringType):
            return r.isNull() | (r == F.lit(""))
        if isinstance(k, _NUMERIC):
            return r.isNull() | (r == F.lit(0))
        if isinstance(k, T.BooleanType):
            return r.isNull() | ~r
        if isinstance(k, (T.ArrayType, T.MapType)):
            return r.isNull() | (F.size(r) == F.lit(0))
        return r.isNull()

    def as_int(self, raw: Column | None = None) -> Column:
        """Lenient int: ints stay, floats truncate, numeric strings parse, else NULL."""
        r = self.raw if raw is None else raw
        k = self.kind
        if k == "json":
            value, text = self._json_as("bigint", raw), self._known("string", raw)
            return value if text is None or self._known("bigint", raw) is not None else _whole(text, value)
        if isinstance(k, (T.StringType, T.BooleanType) + _NUMERIC):
            return r.try_cast("bigint")
        return F.lit(None).cast("bigint")

    def as_float(self, raw: Column | None = None) -> Column:
        """Lenient float: numbers and numeric strings (nan, inf, 1e3) parse, else NULL."""
        r = self.raw if raw is None else raw
        k = self.kind
        if k == "json":
            return _no_suffix(self._json_as("double", raw), self._json_as("string", raw))
        if isinstance(k, T.StringType):
            return _no_suffix(r.try_cast("double"), r)
        if isinstance(k, (T.BooleanType,) + _NUMERIC):
            return r.try_cast("double")
        return F.lit(None).cast("double")

    def as_str_array(self, raw: Column | None = None) -> Column:
        """``[str(p) for p in (x or []) if p is not None]``; a non-array becomes ``[]``."""
        r = self.raw if raw is None else raw
        k = self.kind
        if k == "json":
            arr = self._json_as("array<string>", raw)
        elif isinstance(k, T.ArrayType):
            arr = F.transform(r, lambda x: x.cast("string"))
        else:
            arr = F.lit(None).cast("array<string>")
        return F.coalesce(F.filter(arr, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def _path(name: str) -> str:
    if name.replace("_", "").isalnum():
        return f"$.{name}"
    return "$['" + name.replace("'", "\\'") + "']"


def json_fields(record: str | Column = "record_v") -> FieldAccessor:
    """Field accessor over a VARIANT record column: absent field -> NULL."""
    rec = F.col(record) if isinstance(record, str) else record

    def get(name: str) -> Field:
        return Field(F.try_variant_get(rec, _path(name), "variant"), "json", lambda typ: F.try_variant_get(rec, _path(name), typ))

    get.record = rec  # lets stage_fields extract many fields in one call
    return get


def _struct_of(names: Sequence[str], typ: str) -> str:
    return "struct<" + ",".join(f"`{n}`:{typ}" for n in names) + ">"


def column_fields(schema: T.StructType | DataFrame) -> FieldAccessor:
    """Field accessor over typed columns; names not in the schema are absent (None)."""
    st = schema.schema if isinstance(schema, DataFrame) else schema
    types = {f.name: f.dataType for f in st.fields}

    def get(name: str) -> Field:
        if name in types:
            return Field(F.col(name), types[name])
        return Field(F.lit(None), T.NullType())

    return get


def stage_fields(
    df: DataFrame, fields: FieldAccessor, names: Sequence[str], keep: Sequence[str], numbers: dict[str, str] | None = None
) -> tuple[DataFrame, dict]:
    """Evaluate each field's raw value, ``str()`` and falsiness once per row.

    Returns the staged DataFrame (columns ``_r_<n>``, ``_t_<n>``, ``_f_<n>`` and others, plus
    ``keep``) and a dict name -> Field whose methods read the staged raw column.
    ``numbers``: fields that are wanted as numbers, with the type; of JSON records they are read as that (``_n_<n>``).
    Staging matters for JSON fields: later CASE expressions reference the staged
    columns several times, and Catalyst keeps non-trivial projections that are
    referenced more than once instead of inlining them.
    """
    fs = {n: fields(n) for n in names}
    rec = getattr(fields, "record", None)
    asked = {n: t for n, t in (numbers or {}).items() if n in names} if rec is not None else {}
    if rec is not None:
        # JSON record: one variant->struct cast yields every str(); the rest is read field by field, so that what nobody uses isn't
        names_of = {"_r_": "variant", "_b_": "binary"}
        s2 = df.select(
            F.try_variant_get(rec, "$", _struct_of(names, "string")).alias("_ts"),
            *[F.try_variant_get(rec, _path(n), typ).alias(p + n) for p, typ in names_of.items() for n in names],
            *[F.try_variant_get(rec, _path(n), typ).alias(f"_n_{n}") for n, typ in asked.items()],
            *keep,
        ).select(
            *[F.col(f"_ts.`{n}`").alias(f"_t_{n}") for n in names],
            *[f"{p}{n}" for p in names_of for n in names],
            *[f"_n_{n}" for n in asked],
            *[c for c in df.select(*keep).columns],
        )
    else:
        s1 = df.select(*[fs[n].raw.alias(f"_r_{n}") for n in names], *keep)
        s2 = s1.select("*", *[fs[n].text(F.col(f"_r_{n}")).alias(f"_t_{n}") for n in names])
    known = lambda n: {"string": F.col(f"_t_{n}"), "binary": F.col(f"_b_{n}")} | ({asked[n]: F.col(f"_n_{n}")} if n in asked else {})
    at = lambda n: known(n).get if rec is not None else None
    staged = {n: Field(F.col(f"_r_{n}"), fs[n].kind, at(n)) for n in names}
    s3 = s2.select("*", *[staged[n].falsy(text=F.col(f"_t_{n}")).alias(f"_f_{n}") for n in names])
    return s3, staged


def text_or(*names: str, default: str | None = "") -> Column:
    """``str(a or b or ... or default)`` over staged fields; ``default=None`` returns
    the last operand's ``str()`` as Python's ``or`` does."""
    ops = list(names)
    if default is None:
        *ops, last = ops
        out = F.col(f"_t_{last}")
    else:
        out = F.lit(default)
    for n in reversed(ops):
        out = F.when(~F.col(f"_f_{n}"), F.col(f"_t_{n}")).otherwise(out)
    return out


# --------------------------------------------------------------------------- F1 on string columns
def s_or(*operands: Column | str, default: str = "") -> Column:
    """``a or b or default`` on string columns."""
    cols = [F.col(o) if isinstance(o, str) else o for o in operands]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(default))


# --------------------------------------------------------------------------- F9 id lists
def parse_id_list(text: Column) -> Column:
    """Split on comma and newline, strip whitespace, drop blanks; duplicates kept."""
    parts = F.split(text, "[,\n]")
    stripped = F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x != F.lit(""))


def clean_id_array(arr: Column) -> Column:
    """List form of the id input: elements are stripped and blanks dropped, never split."""
    stripped = F.transform(arr.cast("array<string>"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x.isNotNull() & (x != F.lit("")))


# --------------------------------------------------------------------------- F10 score
def score(trending: Column) -> Column:
    """Recommendation score: trending, or 0.0 when unknown. NaN stays NaN."""
    return F.coalesce(trending.cast("double"), F.lit(0.0))


# --------------------------------------------------------------------------- F11 key injection
def inject_keys(payload_map: Column, **keys: Column | str | int) -> Column:
    """``{k: x, **payload}`` as a ``map<string, variant>``: the payload wins on clashes,
    even when its value is null. Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``."""
    pairs: list[Column] = []
    for k, val in keys.items():
        c = val if isinstance(val, Column) else F.lit(val)
        pairs += [F.lit(k), c.cast("variant")]
    return F.map_concat(F.create_map(*pairs), payload_map)


# --------------------------------------------------------------------------- F12 id fallback
def player_id_text() -> Column:
    """F12 over staged fields ``player_id`` and ``id``: ``str(player_id or id)``;
    NULL when the fallback yields None."""
    return text_or("player_id", "id", default=None)
