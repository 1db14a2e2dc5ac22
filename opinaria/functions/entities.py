"""HTML entity decoding as a column expression.

The names come from the standard library's table of the HTML standard, keyed by their first two
characters so that a look-up compares a few dozen keys instead of all of them.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinaria.session import let


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str]:
    names: dict[str, dict[str, str]] = {}
    bare = []
    for name, chars in html5.items():
        if name.endswith(";"):
            names.setdefault(name[:2], {})[name] = chars
        else:
            bare.append(name)
    legacy = "|".join(sorted(bare, key=lambda n: (-len(n), n)))
    # Numeric references 128..159 mean the Windows-1252 characters.
    windows = {}
    for code in range(0x80, 0xA0):
        try:
            windows[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            windows[str(code)] = chr(code)
    return json.dumps(names), legacy, json.dumps(windows)


def _numeric(ref: Column) -> Column:
    """Character for ``#233`` or ``#xe9`` (with or without ``;``)."""
    digits = F.regexp_extract(ref, "^#[xX]?([0-9a-fA-F]+)", 1)
    is_hex = F.substring(ref, 2, 1).isin("x", "X")
    # More than nine digits is beyond Unicode in either base.
    code = F.when(F.length(digits) > 9, F.lit(0x110000)).otherwise(
        F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint"))
    windows = F.from_json(F.lit(_tables()[2]), "map<string,string>")
    return let(code, lambda n: (
        F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("�"))
        .when(n.between(0x80, 0x9F), F.try_element_at(windows, n.cast("string")))
        .when(((n < 0x20) & ~n.isin(9, 10, 12, 13)) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF)
              | (n.bitwiseAND(0xFFFE) == 0xFFFE), F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))))


def _after_ampersand(part: Column) -> Column:
    names_json, legacy, _ = _tables()
    names = F.from_json(F.lit(names_json), "map<string,map<string,string>>")
    table = F.from_json(F.lit(json.dumps({n: html5[n] for n in html5 if not n.endswith(";")})),
                        "map<string,string>")

    def named(ref: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, F.substring(ref, 1, 2)), ref)

    ref = F.regexp_extract(part, "^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]{0,31};)", 1)
    prefix = F.regexp_extract(part, f"^({legacy})", 1)

    def splice(ref: Column, chars: Column) -> Column:
        return F.concat(chars, part.substr(F.length(ref) + 1, F.length(part)))

    return let(ref, lambda r: F.coalesce(
        F.when(r.startswith("#"), splice(r, _numeric(r))),
        F.when(r != "", splice(r, named(r))),
        let(prefix, lambda p: F.when(p != "", splice(p, F.try_element_at(table, p)))),
        F.concat(F.lit("&"), part)))


def unescape_html(col: Column) -> Column:
    """Replace named and numeric character references."""
    parts = F.split(col, "&")
    return F.array_join(F.transform(
        parts, lambda p, i: F.when(i == 0, p).otherwise(_after_ampersand(p))), "")
