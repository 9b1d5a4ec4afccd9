"""Model replies, read and written by the rules of Python's json module.

What counts as valid, which of two equal keys holds, how numbers are printed and what is
escaped are that module's; each Arrow batch of replies goes through it once. Everything
around it (which replies, which fields, which day) stays in the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from reachlens.fixed_values import IDEA_FIELDS

REFUSED = "refused"
NO_OBJECT, INVALID = "no object", "invalid JSON"


def read_replies(replies: DataFrame, stored: bool = False, ascii_only: bool = True) -> DataFrame:
    """``replies`` with the idea fields of each reply, and in ``refused`` why it has none.

    The object is what stands from the first ``{`` to the last ``}``. A list keeps the order
    and the texts of its items: compact, or with ``stored`` in the layout kept at rest (a
    blank after commas and colons and, with ``ascii_only``, ``\\uXXXX`` for other characters);
    so does an object inside it. Text is taken as it is (half a surrogate pair becomes ``?``),
    other values as they were written, ``null`` and absent fields are null.
    """
    fields, asked = list(IDEA_FIELDS), replies.columns.index("reply")
    names = [*replies.columns, *fields, REFUSED]
    compact, escaped, reasons = not stored, stored and ascii_only, (NO_OBJECT, INVALID)

    # Self-contained, so that workers need nothing but Python itself.
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import re

        class Whole(int):
            pass

        class Part(float):
            pass

        def number(kind):
            def made(text):
                value = kind(text)
                value.text = text
                return value
            return made

        whole, part = number(Whole), number(Part)
        layout = {"ensure_ascii": escaped, "separators": (",", ":") if compact else (", ", ": ")}

        def shown(value):
            if value is None or isinstance(value, str):
                return value if value is None else value.encode("utf-8", "replace").decode()
            if isinstance(value, (list, dict)):
                return json.dumps(value, **layout).encode("utf-8", "replace").decode()
            return value.text if isinstance(value, (Whole, Part)) else json.dumps(value)

        def one(reply):
            found = re.search(r"\{.*\}", reply or "", re.DOTALL)
            if not found:
                return [None] * len(fields) + [reasons[0]]
            try:
                value = json.loads(found.group(0), parse_int=whole, parse_float=part)
            except (ValueError, RecursionError):
                return [None] * len(fields) + [reasons[1]]
            return [shown(value.get(f)) for f in fields] + [None]

        for batch in batches:
            columns = list(zip(*(one(r) for r in batch.column(asked).to_pylist()))) or [()] * (len(fields) + 1)
            yield pa.record_batch([*batch.columns, *[pa.array(c, pa.string()) for c in columns]], names)

    schema = T.StructType([*replies.schema.fields, *[T.StructField(f, T.StringType()) for f in (*fields, REFUSED)]])
    return replies.mapInArrow(read, schema)
