"""Errors with the numeric codes that users of keyed tables know."""

from __future__ import annotations

#: Code to what went wrong.
CODES = {
    108: "a required property of the dataset is missing",
    109: "the kind of source is missing or unknown",
    110: "no key columns are named",
    111: "no table is named",
    112: "no connection string is given",
    113: "no database user is given",
    114: "no database password is given",
    115: "the kind of index is unknown",
    205: "a dataset of this name exists",
    206: "no dataset of this name",
    207: "no key is given",
    208: "the dataset is not loaded",
    210: "changes did not apply to the table",
    213: "columns and values differ in number",
    214: "no column to set is named",
    215: "a value does not fit its column",
    216: "a key column is missing",
    217: "criteria cannot be read",
    218: "key values and key columns differ in number",
    219: "the number of key columns is wrong",
    220: "a column is not part of the key",
    237: "a key value is null",
    241: "a key occurs twice",
    248: "a column that must not be null is null",
    249: "a dataset over this source exists",
    254: "joined columns differ in type",
    504: "the column type is not supported",
    505: "no column of this name",
}


class TableError(Exception):
    """A failure with its code."""

    def __init__(self, code: int, detail: str = "") -> None:
        super().__init__(f"{code}: {CODES[code]}" + (f" ({detail})" if detail else ""))
        self.code = code
