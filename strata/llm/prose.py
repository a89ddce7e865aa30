"""A document's own prose: its text without code, logs, links and quoted lines.

Plain Python over one text at a time, for use inside Arrow batches. Texts are processed whole.

Defined results: a null, empty or blank text has no prose. A fence or a ``<pre>`` that is never
closed runs to the end of the text. A line is dropped as quoted if it begins with ``>``, as code or
log if it is indented by four blanks or a tab, or if identifiers and marks of code outweigh its plain
words (see :func:`evidence`). Dialogue in guillemets and rows of tables are prose.
"""

from __future__ import annotations

import html
import re
import unicodedata

import regex

FENCE = regex.compile(r"(?:```|~~~)[^\n]*\n.*?(?:\n[ \t]*(?:```|~~~)|\Z)", regex.S)
PRE = regex.compile(r"<(pre|code|script|style|kbd|samp)\b[^>]*>.*?(?:</\1\s*>|\Z)", regex.S | regex.I)
QUOTED = regex.compile(r"<(blockquote|q|cite)\b[^>]*>.*?(?:</\1\s*>|\Z)", regex.S | regex.I)
ANCHOR = regex.compile(r"<a\b[^>]*>.*?(?:</a\s*>|\Z)", regex.S | regex.I)
TAG = regex.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", regex.S)
INLINE = regex.compile(r"`[^`\n]*`")
#: A link, and the remark right after it that it leads nowhere. Remarks elsewhere are prose.
DEAD = r"(?:[ \t]*[\[(](?:(?:now|is|page|link|site|404|dead|broken|gone|offline)[ \t]*)+[\])])?"
LINK = regex.compile(r"(?:!?\[[^\]\n]*\]\([^)\n]*\)|!?\[[^\]\n]*\]:\s*\S+|(?:[a-z][a-z0-9+.-]{1,9}://|www\.)\S+)" + DEAD, regex.I)
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*")
ASCII_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*")
LEADING_TAGS = re.compile(r"^(?:[ ]{0,3}</?[A-Za-z][^<>]*>)+")
#: Without any of these a line has neither identifiers nor marks of code or logs.
SUSPECT = re.compile(r"[_{}=<>|\\$;:(\[/]|[a-z][A-Z]")
#: Identifiers: joined by underscores, by inner capitals, or by dots before a bracket.
NAME = regex.compile(r"[\p{L}\d]*_[\p{L}\d_]+|\b\p{Ll}+(?:\p{Lu}[\p{Ll}\d]+)+|\b(?:\p{Lu}[\p{Ll}\d]+){2,}|\b[\p{L}\d]+(?:\.[\p{L}\d]+)+(?=\()")
#: The same with paths, whose parts are joined by two colons.
PATH = regex.compile(r"(?<![\p{L}\d_])[\p{L}\d_]++(?:::[\p{L}\d_]+)+|" + NAME.pattern)
#: Marks of code: operators, calls, subscripts, flags, statement ends.
MARK = regex.compile(r"[{}=<>|\\$]|;\s*$|::|->|=>|(?<=[\p{L}\d_])(?:\(|\[)|(?:^|\s)--?[A-Za-z]\w*|(?:^|\s)\.{0,2}/\w|:\s*$|\+\d+ ms\b|\((?i:code) \d+\)|(?<=\w):(?= \w+[_(])")
LEVEL = regex.compile(r"\b(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b|^(?:error|warning|fatal|panic): |\bpanicked at\b")
DIGIT = re.compile(r"[0-9]")
CLOCK = regex.compile(r"^\[?(?:\d{4}-\d\d-\d\d[ T])?\d\d:\d\d:\d\d")
OPENING = frozenset(
    "assert async await break case catch class const continue def delete do elif else enum except export finally fn for from func function if import insert int let"
    " match new package print private public raise return select static struct switch throw try update use var void while with".split()
)


def evidence(line: str) -> tuple[bool, bool]:
    """(is it code or a log, could it be beside such lines) of one line without its indentation.

    No word alone tells: a line is code or a log only where identifiers and marks of code outweigh
    its plain words. Sentences that begin with for, if, return or SELECT, hold brackets and
    semicolons, or name one identifier stay prose.
    """
    if not line:
        return False, False
    first = line.split(None, 1)[0].lower().rstrip(":({;")
    opens = first in OPENING
    if not SUSPECT.search(line):
        return False, opens and len(line.split()) <= 3
    pattern = PATH if "::" in line else NAME
    names = pattern.findall(line)
    marks = len(MARK.findall(line))
    logged = (LEVEL.search(line) is not None) + (CLOCK.match(line) is not None)
    some = marks + opens + logged
    if not names and marks < 2 and logged < 2 and not line.startswith(("Traceback (", ">>> ")):
        return False, bool(some) and line.count(" ") <= 4
    if line.count(" ") > 4 * (3 * len(names) + marks + some) + 40:
        return False, False  # far more words than evidence
    bare = pattern.sub(" ", line)
    plain = sum(len(w) > 1 and w.lower() not in OPENING for w in WORD.findall(bare))
    if logged == 2 and plain <= 12 or line.startswith(("Traceback (", ">>> ")):
        return True, True
    if len(names) > 1 or names and some:
        share = sum(map(len, names)) + 2 * marks + len(DIGIT.findall(bare))
        machine = 5 * share >= 2 * len(line.replace(" ", "")) and 3 * len(names) + marks + some > plain
    else:
        machine = marks > 1 and marks + opens > plain
    return machine, machine or bool(some) and plain <= 3


def is_machine_line(line: str) -> bool:
    """Is the line, taken by itself, code or a log?"""
    return evidence(line.strip())[0]


def _without_machine_lines(lines: list[str]) -> list[str]:
    """The lines of prose; a short line with a mark of code between or beside machine lines goes with them."""
    seen = [(line, *evidence(line.strip())) for line in lines]
    if not any(machine for _, machine, _ in seen):
        return lines
    out = []
    for i, (line, machine, could) in enumerate(seen):
        if machine:
            continue
        beside = could and (i and seen[i - 1][1] or i + 1 < len(seen) and seen[i + 1][1])
        if not beside:
            out.append(line)
    return out


MOJIBAKE = regex.compile(r"[ÃÂâ][\x80-\xbf\u0152-\u2122]")
INVISIBLE = regex.compile(r"[\u00ad\p{Cf}]")


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte code page is turned back where that is possible; NFC."""
    if MOJIBAKE.search(text):
        text = MOJIBAKE_RUN.sub(_recoded, text)
    return unicodedata.normalize("NFC", INVISIBLE.sub("", text))


MOJIBAKE_RUN = regex.compile(r"[\x80-\xff\u0152-\u0178\u02c6-\u02dc\u2013-\u203a\u20ac\u2122]{2,}")


def _recoded(m: regex.Match) -> str:
    for page in ("cp1252", "latin-1"):
        try:
            return m[0].encode(page).decode("utf-8")
        except UnicodeError:
            pass
    return m[0]


def own_prose(text: str | None) -> str:
    if not text or text.isspace():
        return ""
    if not text.isascii():
        text = repaired(text).replace("\xa0", " ")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    if "<" in text:
        text = ANCHOR.sub(" ", QUOTED.sub("\n", PRE.sub("\n", text)))
    kept = []
    for line in text.split("\n"):
        if "<" in line:  # tags before an indentation do not hide it
            line = LEADING_TAGS.sub("", line)
        if not line or line.startswith(("    ", "\t", " \t")):
            continue
        if "<" in line:
            line = TAG.sub(" ", line)
        if "&" in line:
            line = html.unescape(line)
        if line.lstrip().startswith(">"):
            continue
        if "`" in line:
            line = INLINE.sub(" ", line)
        if "](" in line or "]:" in line or "://" in line or "www." in line.lower():
            line = LINK.sub(" ", line)
        kept.append(line)
    return "\n".join(_without_machine_lines(kept))


def words(text: str | None) -> list[str]:
    """Lower-case words of the own prose, in order."""
    own = own_prose(text)
    if own.isascii():
        return ASCII_WORD.findall(own.lower())
    return [w.replace("’", "'") for w in WORD.findall(own.lower())]
