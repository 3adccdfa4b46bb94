"""Text expressions: trimming, addresses, headers, model inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.schema import CATEGORIES

# Lengths in characters, and the floor of confidence.
SNIPPET_CHARS = 500
PROMPT_CHARS = {"sender": 200, "subject": 200, "snippet": 400}
CONFIDENCE_FLOOR = 0.6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(c: Column) -> Column:
    """c without white space, in Unicode's sense, at its ends."""
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def embedding_text(subject: Column, sender: Column, snippet: Column) -> Column:
    """Three lines: subject, sender, the first 500 characters of the snippet; absent parts are empty."""
    part = lambda c: F.coalesce(trimmed(c), F.lit(""))
    return F.concat(part(subject), F.lit("\n"), part(sender), F.lit("\n"), F.left(part(snippet), F.lit(SNIPPET_CHARS)))


def sender_email(sender: Column) -> Column:
    """The address in the first angle brackets if it has an '@', else the whole if that has one, else null."""
    whole = trimmed(sender)
    inner = trimmed(F.regexp_extract(whole, r"^[^<]*<([^>]*)>", 1))
    return ascii_lower(F.when(inner.contains("@"), inner).when(whole.contains("@"), whole))


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, whatever its case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def shortened(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def cluster_prompt(key: Column, count: Column, samples: Column) -> Column:
    """The question to the classifier: what the cluster is, and its samples (sender, subject, snippet)."""
    part = lambda s, f: shortened(F.coalesce(s[f], F.lit("")), PROMPT_CHARS[f])
    block = lambda s, i: F.concat(F.lit("Message "), (i + 1).cast("string"), *(x for f in PROMPT_CHARS for x in (F.lit(f"\n  {f}: "), part(s, f))))
    head = F.concat(F.lit("Name the one category that fits this group of messages. Categories: " + ", ".join(CATEGORIES) + ".\nGroup: "), key, F.lit("\nSize: "), count.cast("string"))
    return F.concat_ws("\n", head, F.concat_ws("\n", F.transform(samples, block)))


def unfenced(raw: Column) -> Column:
    """raw without white space and code fences, single or repeated, at its ends."""
    body = F.regexp_replace(trimmed(raw), r"^(?:```json)*(?:```)*", "")
    return trimmed(F.regexp_replace(body, r"(?:```)+$", ""))


def model_output(raw: Column) -> dict[str, Column]:
    """category, confidence, reason and valid of a model's answer, which may stand in code fences.

    Not valid, and so unknown with confidence 0: what isn't one JSON object and nothing else, has one of the three keys
    twice, lacks a string as category or a finite number as confidence, or has a reason that is neither string nor null.
    Other keys don't matter, however often they occur. The confidence is put between 0 and 1; below the floor the
    category is unknown; so is any category, lower-cased, that is not in the domain.
    """
    body = unfenced(raw)
    # The parser stops at the end of the first value. Inside an object that ends with the body's own digest, whatever
    # stands after that value is an error, or the digest is missing.
    fields = ("category", "confidence", "reason")
    shape = f"v struct<{','.join(f'{f}: variant' for f in fields)}>, end string"
    whole = F.from_json(F.concat(F.lit('{"v":'), body, F.lit(',"end":"'), F.sha2(body, 256), F.lit('"}')), shape, {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    value = lambda path, kind: F.try_variant_get(whole["v"][path], "$", kind)
    kind = lambda path: F.coalesce(F.schema_of_variant(whole["v"][path]), F.lit("VOID"))
    own = F.filter(F.json_object_keys(body), lambda k: k.isin(*fields))
    number = value("confidence", "double")
    valid = (
        (whole["end"] == F.sha2(body, 256)) & (F.size(own) == F.size(F.array_distinct(own))) & (kind("category") == "STRING") & kind("reason").isin("VOID", "STRING")
        & kind("confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.abs(number) < F.lit(float("inf")))
    )
    valid = F.coalesce(valid, F.lit(False))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)).cast("float")
    known = ascii_lower(value("category", "string"))
    category = F.when(valid & (sure >= F.lit(CONFIDENCE_FLOOR).cast("float")) & known.isin(*CATEGORIES), known).otherwise("unknown")
    return {"category": category, "confidence": F.when(valid, sure).otherwise(F.lit(0.0).cast("float")), "reason": F.when(valid, value("reason", "string")), "valid": valid}


def csv_field(c: Column) -> Column:
    """Quoted only where a comma, quote or line feed is in it; null is empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def cluster_key(account: Column, email: Column, part: Column | None = None) -> Column:
    """sender::<address>, or a key of the account's own for unknown senders; #n for part n of a bucket above 0."""
    base = F.when(F.coalesce(email, F.lit("")) != "", F.concat(F.lit("sender::"), email)).otherwise(F.concat(F.lit("unknown::"), F.left(F.sha2(account, 256), F.lit(16))))
    return base if part is None else F.when(part > 0, F.concat(base, F.lit("#"), part.cast("string"))).otherwise(base)
