"""String expressions: strip, tokens, null rendering, JSON preview text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The characters Python treats as white space in str.strip() and
# str.split(), as text and as a Java character class. The class looks at the
# rare wide spaces only inside their range, which keeps it fast on letters.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\x{1680}-\x{3000}&&"
    r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)

# The public mteval-v13a tokenisation, as (pattern, replacement).
# The first pattern lists ASCII punctuation but ' , - . one by one: Java tests a
# plain list with one table look-up per character, and ranges one after another.
MTEVAL_13A_RULES = (
    (r"[!\"#$%&()*+/:;<=>?@\[\\\]^_`{|}~]", " $0 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
MTEVAL_13A_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))

# Fixed value: a ROUGE token.
ROUGE_TOKEN = "[a-z0-9]+"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def tokens_13a(text: Column) -> Column:
    """Tokens of the BLEU tokeniser (mteval-v13a)."""
    line = F.replace(text, F.lit("<skipped>"), F.lit(""))
    line = F.replace(line, F.lit("-\n"), F.lit(""))
    line = F.replace(line, F.lit("\n"), F.lit(" "))
    for entity, char in MTEVAL_13A_ENTITIES:
        line = F.replace(line, F.lit(entity), F.lit(char))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, replacement in MTEVAL_13A_RULES:
        line = F.regexp_replace(line, pattern, replacement)
    return words(line)


def tokens_rouge(text: Column) -> Column:
    """Lower-cased runs of letters a-z and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(ROUGE_TOKEN), F.lit(0))


def as_text(value: Column, null_text: str = "") -> Column:
    """A value as rendered text; NULL becomes ``null_text``."""
    return F.coalesce(value.cast("string"), F.lit(null_text))


def json_text(value: Column, dtype: T.DataType) -> Column:
    """JSON with ``", "`` and ``": "`` separators, nulls kept, non-ASCII unescaped."""
    if isinstance(dtype, T.StructType):
        parts = [
            F.concat(F.lit(f'"{f.name}": '), json_text(value[f.name], f.dataType))
            for f in dtype.fields
        ]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda x: json_text(x, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.StringType):
        quoted = F.to_json(F.array(value))
        text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(dtype, (T.MapType, T.VariantType)):
        text = F.to_json(value)
    else:
        quoted = F.to_json(F.array(value.cast("string")))
        text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)
