"""Markdown notes: front matter that is merged and never rewritten by hand-made keys, and album lists.

Front matter is edited by line: keys that are not ours, comments and their formatting stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from decimal import Decimal

MARKER = "<!-- lumenstack:notes -->"
LIST_NOTE = "[ This list of photos is generated and rebuilt on every run. Notes below the marker at the end of the file are kept. ]: #\n\n"

_FRONT = re.compile(r"[\r\n]*---(\r?\n)(.*?)---(\r?\n|)", re.S)
_KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^\s#\-\[\]{}&*!|>%@`\"'][^:]*?)\s*:(?:[ \t]+(.*))?\Z", re.S)
_ITEM = re.compile(r"(\s*)-\s+(.*)\Z", re.S)
_FLOW = re.compile(r"\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^,]+?)\s*(?:,|\Z)")
_QUOTED = re.compile(r"\s|.*\s\Z|[&*?|\-<>=!%@]|.*[:{}\[\],#`\"'\\\x00-\x1f]|[~.]?\Z|(?i:null|true|false|yes|no|on|off|y|n)\Z|[+-]?(?:0x[0-9a-fA-F]+|0o[0-7]+|[0-9.][0-9_.]*(?:[eE][+-]?[0-9]+)?|\.(?:inf|nan))\Z", re.S)


def split_front(text: str) -> tuple[str, str]:
    """(front matter, body). Where the fences are malformed or hold nothing, all is body."""
    m = _FRONT.match(text)
    if not m or not m[2].strip():
        return "", text
    rest = text[m.end() :]
    body = (rest or m[3]) if m[3] else (m[1] + rest if rest else "")
    return m[2].rstrip("\r\n"), body


def quoted(value: str) -> str:
    """A string as a YAML scalar, in double quotes where it would not be read back as itself."""
    if value and not _QUOTED.match(value):
        return value
    body = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{body}"'


def unquoted(raw: str) -> str:
    raw = raw.strip()
    if len(raw) > 1 and raw[0] == raw[-1] == '"':
        escapes = {"n": "\n", "r": "\r", "t": "\t"}
        return re.sub(r"\\(.)", lambda m: escapes.get(m[1], m[1]), raw[1:-1], flags=re.S)
    if len(raw) > 1 and raw[0] == raw[-1] == "'":
        return raw[1:-1].replace("''", "'")
    return re.sub(r"\s+#.*\Z", "", raw, flags=re.S)


def number(x: float) -> str:
    """Shortest decimal form, without exponent; whole numbers have no point."""
    text = format(Decimal(repr(float(x))), "f")
    return text[:-2] if text.endswith(".0") else text


def _entries(front: str) -> list[list[str]]:
    """Lines by top-level key: each entry begins with its key line; lines before the first key come first."""
    out: list[list[str]] = [[]]
    for line in front.splitlines():
        if not line.strip() or line[0] in " \t#" or (line[0] == "-" and len(out) > 1):
            out[-1].append(line)
        elif _KEY.match(line):
            out.append([line])
        else:
            raise ValueError("the front matter is not a mapping")
    if len(out) == 1:
        raise ValueError("the front matter has no mapping")
    return out


def _add_items(entry: list[str], values: Sequence[str]) -> None:
    """Append what an array lacks; what is no array stays."""
    key, inline = _KEY.match(entry[0]).groups()
    inline = re.sub(r"\A#.*|\s+#.*\Z", "", (inline or "").strip())
    items = [(i, m) for i, line in enumerate(entry) if i and (m := _ITEM.match(line))]
    if inline.startswith("[") and inline.endswith("]"):
        held = [m[1] for m in _FLOW.finditer(inline[1:-1])] if inline[1:-1].strip() else []
        fresh = [v for v in values if v not in set(map(unquoted, held))]
        if fresh:
            entry[0] = f"{key}: [{', '.join(held + list(map(quoted, fresh)))}]"
    elif not inline and items:
        held = {unquoted(m[2]) for _, m in items}
        indent, last = items[0][1][1], items[-1][0]
        while last + 1 < len(entry) and entry[last + 1].strip() and not entry[last + 1].lstrip().startswith("#"):
            last += 1
        entry[last + 1 : last + 1] = [f"{indent}- {quoted(v)}" for v in values if v not in held]


def merge_front(front: str | None, scalars: Mapping[str, str | float | None], arrays: Mapping[str, Sequence[str]]) -> tuple[str, bool]:
    """(front matter with a newline at its end, whether it changed). front is None for a new note; an
    existing one that is no mapping is an error. Scalars are set where they stand, arrays united."""
    entries = [[]] if front is None else _entries(front)
    before = [list(e) for e in entries]
    at = {unquoted(_KEY.match(e[0])[1]): e for e in entries if e and _KEY.match(e[0]) and e[0][0] not in " \t#"}
    for key, value in scalars.items():
        if value is None:
            continue
        text = quoted(value) if isinstance(value, str) else number(value)
        if key not in at:
            entries.append([f"{key}: {text}"])
        elif len(at[key]) > 1 and any(x.strip() and not x.lstrip().startswith("#") for x in at[key][1:]):
            at[key][:] = [f"{key}: {text}"]
        elif unquoted(_KEY.match(at[key][0])[2] or "") != unquoted(text):
            at[key][0] = f"{key}: {text}"
    for key, values in arrays.items():
        if key in at:
            _add_items(at[key], values)
        elif values:
            entries.append([f"{key}:", *(f"  - {quoted(v)}" for v in values)])
    return "\n".join(line for e in entries for line in e) + "\n", entries != before


def note_body(media_name: str, video: str | None) -> str:
    """The body of a new note: the photo, and a link to its Live Photo video."""
    return f"\n![]({media_name})\n" + (f"\n[Live Photo video]({video})\n" if video else "")


def merged_note(existing: str | None, media_name: str, scalars: Mapping[str, str | float | None], arrays: Mapping[str, Sequence[str]]) -> str | None:
    """The note's new text, or None where nothing changes. An existing body is kept as it is."""
    front, body = (None, note_body(media_name, scalars.get("live-photo-video"))) if existing is None else split_front(existing)
    text, changed = merge_front(front, scalars, arrays)
    return f"---\n{text}---\n{body}" if changed else None


def album_notes(existing: str) -> str:
    """What the user wrote below the first marker."""
    _, found, after = existing.partition(MARKER)
    return re.sub(r"\A\r?\n", "", after) if found else ""


def album_markdown(title: str, targets: Sequence[str], existing: str = "", up: str = "../") -> str:
    photos = "".join(f"\n![Photo]({up}{t})" for t in targets)
    return f"{LIST_NOTE}# {title}\n\n{photos}\n\n{MARKER}\n{album_notes(existing)}"
