"""Permission modes: rendering, parsing and the two grammars of symbolic changes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
CLASS_SHIFT = {"u": 6, "g": 3, "o": 0}
PERMISSION = {"r": 4, "w": 2, "x": 1}
SET_ID = {"u": 0o4000, "g": 0o2000}
STICKY = 0o1000


def octal(mode) -> Column:
    """Four octal digits."""
    return F.lpad(F.conv((F.col(mode) if isinstance(mode, str) else mode).cast("string"), 10, 8), 4, "0")


def parse_octal(text) -> Column:
    """The mode of one to four octal digits; else null."""
    x = F.col(text) if isinstance(text, str) else text
    return F.when(x.rlike("^[0-7]{1,4}$"), F.conv(x, 8, 10).cast("int"))


def symbolic(mode) -> Column:
    """Nine letters, like rwxr-sr-T."""
    m = F.col(mode) if isinstance(mode, str) else mode
    has = lambda bit: m.bitwiseAND(bit) != 0
    letters = []
    for shift, special, on in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, STICKY, "t")):
        letters.append(F.when(has(4 << shift), "r").otherwise("-"))
        letters.append(F.when(has(2 << shift), "w").otherwise("-"))
        letters.append(F.when(has(special), F.when(has(1 << shift), on).otherwise(on.upper())).otherwise(F.when(has(1 << shift), "x").otherwise("-")))
    return F.concat(*letters)


def parse_change(text: str) -> int | list[tuple[str, str, str]] | None:
    """An octal mode as a number, a symbolic one as (classes, operator, permissions) clauses; None if it is neither.

    One operator a clause and the permissions r, w, x and X only.
    """
    if re.fullmatch("[0-7]{1,4}", text):
        return int(text, 8)
    clauses = [re.fullmatch("([ugoa]*)([-+=])([rwxX]*)", c) for c in text.split(",")]
    return [(m[1] or "a", m[2], m[3]) for m in clauses] if all(clauses) else None


def _bits(classes: str, permissions: str, mode: int, is_dir: bool) -> int:
    out = 0
    for c in "ugo" if "a" in classes else classes:
        for p in permissions:
            if p == "X":
                out |= (1 if is_dir or mode & 0o111 else 0) << CLASS_SHIFT[c]
            elif p in PERMISSION:
                out |= PERMISSION[p] << CLASS_SHIFT[c]
    return out


def apply_change(mode: int, change: int | list[tuple[str, str, str]], is_dir: bool) -> int:
    """The mode after a change; X looks at the mode as the clauses before left it. Special bits stay with symbolic changes."""
    if isinstance(change, int):
        return change
    for classes, operator, permissions in change:
        bits = _bits(classes, permissions, mode, is_dir)
        if operator == "+":
            mode |= bits
        elif operator == "-":
            mode &= ~bits
        else:
            mode = mode & ~_bits(classes, "rwx", mode, is_dir) | bits
    return mode


def changed(mode, change: str, is_dir) -> Column:
    """apply_change() as a column expression for one given change."""
    m = F.col(mode) if isinstance(mode, str) else mode
    folder = F.col(is_dir) if isinstance(is_dir, str) else is_dir
    parsed = parse_change(change)
    if parsed is None:
        raise ValueError(f"invalid mode: {change!r}")
    if isinstance(parsed, int):
        return F.lit(parsed)
    for classes, operator, permissions in parsed:
        fixed = F.lit(_bits(classes, permissions.replace("X", ""), 0, False))
        if "X" in permissions:
            wide = F.lit(_bits(classes, "x", 0, False))
            fixed = F.when(folder | (m.bitwiseAND(0o111) != 0), fixed.bitwiseOR(wide)).otherwise(fixed)
        if operator == "+":
            m = m.bitwiseOR(fixed)
        elif operator == "-":
            m = m.bitwiseAND(F.bitwise_not(fixed))
        else:
            m = m.bitwiseAND(~_bits(classes, "rwx", 0, False)).bitwiseOR(fixed)
    return m


def mkdir_mode(text: str | None, umask: int = 0o022) -> int | None:
    """The mode that a new folder gets: 0777 less the umask, or what the mode says from 0777 on, umask left aside.

    Symbolic modes may chain operators and use s and t here. None if the mode is invalid.
    """
    if text is None:
        return 0o777 & ~umask
    if re.fullmatch("[0-7]{1,4}", text):
        return int(text, 8)
    mode = 0o777
    for clause in text.split(","):
        m = re.fullmatch("([ugoa]*)((?:[-+=][rwxXst]*)+)", clause)
        if not m:
            return None
        classes = "ugo" if not m[1] or "a" in m[1] else m[1]
        for operator, permissions in re.findall("([-+=])([rwxXst]*)", m[2]):
            bits = _bits(classes, permissions, mode, True)
            if "s" in permissions:
                bits |= sum(SET_ID[c] for c in set(classes) if c in SET_ID)
            if "t" in permissions and (not m[1] or set(m[1]) & set("ao")):
                bits |= STICKY
            if operator == "+":
                mode |= bits
            elif operator == "-":
                mode &= ~bits
            else:
                cleared = _bits(classes, "rwx", mode, True) | sum(SET_ID[c] for c in set(classes) if c in SET_ID)
                mode = mode & ~cleared | bits
    return mode


def report_line(path, old, new) -> Column:
    """What a verbose mode change says of one path."""
    same = F.format_string("mode of '%s' retained as %s (%s)", path, octal(old), symbolic(old))
    other = F.format_string("mode of '%s' changed from %s (%s) to %s (%s)", path, octal(old), symbolic(old), octal(new), symbolic(new))
    return F.when(old == new, same).otherwise(other)
