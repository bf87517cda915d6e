"""Hashing, masking and removal of personal data. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same, but tried only where a name may begin: else a long word is tried from each of its letters.
_EMAIL_START = r"(?<![A-Za-z0-9._%+-])"
PHONE = r"\+?\d[\d\s().-]{7,}\d"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def hashed(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def masked_ip(c: Column, last: str = ".XXX") -> Column:
    return F.regexp_replace(c, r"\.\d+$", last)


def anonymous_ip(c: Column) -> Column:
    """An IPv4 address with 0 for its last part; others stay."""
    return F.regexp_replace(c, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", "$1.0")


def masked_email(c: Column) -> Column:
    return F.regexp_replace(c, "@.*", "@XXX.com")


def masked_phone(c: Column) -> Column:
    return F.regexp_replace(c, r"\d{4}$", "XXXX")


def masked_id(c: Column) -> Column:
    """The first and last two characters of more than four, else none."""
    return F.when(c.isNotNull(), F.when(F.length(c) > 4, F.concat(F.substring(c, 1, 2), F.lit("XXX"), F.right(c, F.lit(2)))).otherwise("XXX"))


def masked_text(c: Column) -> Column:
    """Running text with its e-mail addresses, IPv4 addresses and phone numbers masked."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, _EMAIL_START + EMAIL, "[email]"), IPV4, "[ip]"), PHONE, "[phone]")


def masked(name: str, c: Column) -> Column:
    """Masked by what the column's name says it holds."""
    parts = name.lower().split(".")[-1].split("_")
    if "ip" in parts:
        return masked_ip(c)
    if "email" in parts:
        return masked_email(c)
    if "phone" in parts:
        return masked_phone(c)
    return masked_id(c)


def _type(schema: DataType, path: list[str]) -> DataType | None:
    for part in path:
        if not isinstance(schema, StructType) or part not in schema.names:
            return None
        schema = schema[part].dataType
    return schema


def scrub(df: DataFrame, how: dict[str, str], salt: str = "", mark: str | None = "pii_scrubbed") -> DataFrame:
    """df with columns, or fields of structs by dotted name, treated: ``hash``, ``mask``, ``anonymize`` or ``remove``.

    Names that df doesn't have are passed over. ``mark`` names a column that says whether any was there.
    """
    top: dict[str, Column] = {}
    done = False
    for name, way in how.items():
        path = name.split(".")
        kind = _type(df.schema, path)
        if kind is None:
            continue
        done = True
        value = F.col(".".join(f"`{p}`" for p in path))
        if way == "hash":
            if not salt:
                raise ValueError("hashing needs a salt")
            new = hashed(value, salt)
        elif way == "mask":
            new = masked(name, value.cast("string"))
        elif way == "anonymize":
            new = anonymous_ip(value)
        elif way == "remove":
            new = F.lit(None).cast(kind)
        else:
            raise ValueError(f"no such treatment: {way}")
        base = top.get(path[0], F.col(f"`{path[0]}`"))
        top[path[0]] = new if len(path) == 1 else F.when(base.isNotNull(), base.withField(".".join(path[1:]), new))
    if mark:
        top[mark] = F.lit(done)
    return df.withColumns(top) if top else df


def scrubbing_stats(df: DataFrame, mark: str = "pii_scrubbed") -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(mark)).alias("scrubbed"))
