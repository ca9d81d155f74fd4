"""From payload text to row documents."""

from __future__ import annotations

import json
from typing import Any

from emergent.functions.lattice import PayloadError

_decoder = json.JSONDecoder()
_SPACE = " \t\r\n"


def loads(text: str) -> Any:
    """One JSON value and nothing behind it. NaN and infinities are numbers; of equal keys the last counts."""
    value, end = _decoder.raw_decode(text, len(text) - len(text.lstrip(_SPACE)))
    if end < len(text) and text[end:].strip(_SPACE):
        raise ValueError("trailing text")
    return value


def split(text: str, ignore_errors: bool = False) -> tuple[list[Any], int]:
    """The row documents of a payload and the number of lines that aren't JSON.

    A text that is one document gives its elements if it is an array, else itself; any other text is read line by line, and there an array
    is one row.
    """
    try:
        whole = loads(text)
    except (ValueError, RecursionError):
        whole = None
    else:
        return (whole if isinstance(whole, list) else [whole]), 0
    rows, errors = [], 0
    for number, line in enumerate(text.split("\n"), 1):
        if line.strip(_SPACE):
            try:
                rows.append(loads(line))
            except (ValueError, RecursionError):
                if not ignore_errors:
                    raise PayloadError(f"payload is not valid JSON or NDJSON (parse error on line {number})") from None
                errors += 1
    return rows, errors


def check_uniform(objects: int, rows: int) -> bool:
    """Whether rows are bare values, for one column named value; rows can't be both."""
    if objects not in (0, rows):
        raise PayloadError("payload mixes JSON objects with non-object values")
    return rows > 0 and objects == 0
