"""Sentence boundaries across languages and scripts, as offsets in code points.

A pushdown automaton reads each line of a text from mark to mark. Its stack holds the quotations and brackets that are
open (only those that are closed again in the line), and no sentence ends inside them; another, kept over the lines, the
lists that are open, by their indents. A list number opens the sentence it stands in. A terminator ends a sentence unless a trie of abbreviations, read backwards, or a number says otherwise, or
what follows goes on in lower case. Closing marks and emoji belong to the sentence before them. In scripts without
capitals, and in texts written all in small or all in capital letters, case says nothing, and abbreviations decide.
Chinese and Japanese end at their own terminators without a space; Thai ends at spaces between Thai letters.

Defined results: null and blank texts give no sentence; a text of marks only is one sentence; repeated rows of an id give
its sentences once (several texts of an id are all split); extra columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionframe.session import spread

# Abbreviations without their last full stop and without spaces; pairs of marks; months after "3.".
#: Never the end of a sentence.
NEVER = "ул пер просп пл д кв корп ок напр см стр рис т.е т.к т.н им проф тел ср гл п mr mrs ms dr st vs e.g i.e approx incl prof nr ca inkl z.b bzw ggf u.a d.h fig डॉ श्री د".split()
#: The end of a sentence if the next one starts visibly; before digits and in texts without case they go on.
RARELY = "г гг др пр тыс млн млрд ч мин сек кг р.м p.m a.m u.s inc co ltd jr sr".split()
#: As those, but the end of a sentence also before digits and in texts without case.
OFTEN = "т.д т.п руб коп etc usw".split()
#: Only before digits are they abbreviations.
NUMBERED = "no art".split()
OPENING, CLOSING = "«“„‘「『(（[【《〈", "»”“’」』)）]】》〉"
_CLOSES = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉"}
_BRACKETS = "(（[【"
MONTHS = re.compile(r"\s*(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b", re.I)
#: Common top-level domains, with those RFC 2606 reserves for examples, and endings of files.
DOMAINS = re.compile(r"(?:com|net|org|info|biz|io|co|eu|ru|su|de|uk|fr|cn|jp|example|invalid|test|localhost|html?|php|pdf|txt)\b", re.I)

_EMOJI = "\U0001f000-\U0001faff☀-➿⬀-⯿⌀-⏿️‍"
_TERM = ".!?…。！？।॥؟۔｡"
_MARK = re.compile(rf"[{_TERM}]+|[{_EMOJI}]+|(?<=[฀-๿]) +(?=[฀-๿«“「(\"])|[«»“”„「」『』()（）\[\]【】《》〈〉\"]")
_TAIL = re.compile(rf"[»”“’」』)）\]】》〉\"']+|[ \t ]*[{_EMOJI}]+")
_LINE = re.compile(r"[^\n\r  \x0b\x0c\x85]+")
_NUMBER_FIRST = re.compile(r"[\s\-•*–—·(]*\d{1,3}$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿＀-￯]")
#: A list number or bullet at the start of a line, with what is before it.
_ITEM = re.compile(r"([ \t\u3000]*)(?:\d{1,3}[.)]|[-•*–—·])[ \t]")
_EMOJI_ONLY = re.compile(rf"[{_EMOJI}]")


def _trie(groups: dict[str, list[str]]) -> dict:
    root: dict = {}
    for kind, words in groups.items():
        for w in words:
            node = root
            for ch in reversed(w):
                node = node.setdefault(ch, {})
            node[""] = kind
    return root


ABBREVIATIONS = _trie({"never": NEVER, "rarely": RARELY, "often": OFTEN, "numbered": NUMBERED})


def abbreviation(text: str, start: int, end: int) -> str | None:
    """The kind of the longest abbreviation that ends before ``text[end]`` (a full stop), if it is a whole word."""
    node, kind, i = ABBREVIATIONS, None, end - 1
    while i >= start:
        ch = text[i]
        if ch in "  " and i + 1 < end and i > start and text[i - 1] == "." and "." in node:
            i -= 1
            continue
        node = node.get(ch.lower())
        if node is None:
            break
        if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] == "." and i - 1 > start and text[i - 2].isalpha())):
            kind = node[""]
        i -= 1
    return kind


def _matched(line: str) -> dict[int, int]:
    """Where marks open (to where they close) in a line; what is never closed doesn't open."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    for m in re.finditer(r"[«»“”„「」『』()（）\[\]【】《》〈〉\"]", line):
        ch, i = m.group(), m.start()
        at = next((k for k in range(len(stack) - 1, -1, -1) if (stack[k][0] == '"' if ch == '"' else _CLOSES.get(stack[k][0]) == ch)), None)
        if at is not None and (ch not in _CLOSES or ch == "“"):
            pairs[stack[at][1]] = i
            del stack[at:]
        elif ch in _CLOSES or ch == '"':
            stack.append((ch, i))
    return pairs


def _tail(line: str, i: int, pairs: dict[int, int]) -> int:
    """Where closing marks and emoji after i end; a mark that opens a quotation isn't one of them."""
    while t := _TAIL.match(line, i):
        opens = next((k for k in range(t.start(), t.end()) if k in pairs), t.end())
        if opens == i:
            break
        i = opens
    return i


def _starts(line: str, i: int, caseless: bool) -> bool | None:
    """Whether what stands at i starts a sentence: True or False by its case, None at the end of the line."""
    n = len(line)
    while i < n and (line[i].isspace() or line[i] in "-–—•*·"):
        i += 1
    if i >= n:
        return None
    while i < n and not line[i].isalnum():
        if line[i] in ",;:":
            return False
        i += 1
    if i >= n:
        return True
    ch = line[i]
    return True if caseless or ch.isdigit() or not ch.islower() else False


def _ends(line: str, start: int, m_start: int, m_end: int, after: int, caseless: bool) -> bool:
    """Whether the terminators at [m_start, m_end), with closing marks and emoji up to ``after``, end the sentence."""
    marks, nxt = line[m_start:m_end], line[after : after + 1]
    tail = line[m_end:after]
    if nxt and nxt in ",;:":
        return False
    if marks in ("...", "…", "..") and not tail and len(line[start:m_start].split()) == 1 and line[start:m_start].strip().isalpha() and not _CJK.match(line[m_start - 1 : m_start]):
        return False
    starts = _starts(line, after, caseless)
    dash = line[after:].lstrip()[:1] in ("-", "–", "—") and not re.match(r"\s*[-–—]\s*[A-ZА-ЯЁ\d]", line[after:])
    if dash and (tail or marks != "."):
        return False
    if marks == ".":
        before = line[m_start - 1 : m_start]
        if not nxt.isspace() and nxt and not tail:
            if nxt.isdigit():
                return False
            if before.isdigit() and nxt.isalpha() and not nxt.isupper():
                return False
            if nxt.isalpha():
                if DOMAINS.match(line, m_end) or not before.isalpha():
                    return bool(before) and not before.isalnum() and starts is True
                if nxt.isascii() and (caseless or nxt.islower()):
                    return False
        if _NUMBER_FIRST.fullmatch(line[start:m_start]) and starts is not None:
            return False
        if before.isdigit() and MONTHS.match(line, m_end):
            return False
        single = before.isalpha() and not (m_start > start + 1 and line[m_start - 2].isalnum())
        kind = abbreviation(line, start, m_start)
        if single and before.isupper() and not caseless and kind != "never" and line[m_start - 2 : m_start - 1] != ".":
            kind = "never" if starts is not None else kind  # an initial
        rest = line[after:].lstrip()
        if starts is not None and kind and not tail:
            digit = rest[:1].isdigit()
            if kind == "never" or kind == "numbered" and digit:
                return False
            if kind == "rarely" and (digit or caseless):
                return False
            if kind == "often" and caseless and re.match(r"(?:и|and|und)\b", rest, re.I):
                return False
        if kind is None and not tail and single and starts is not None:
            return False
    return starts is not False


def split(text: str) -> list[tuple[int, int]]:
    """The sentences of ``text`` as offsets [start, end) without outer white space, in order."""
    return [(a, b) for a, b, _ in split_levels(text)]


def _list_level(line: str, stack: list[int]) -> int:
    """How deep in lists a line stands. ``stack`` holds the indents of the open lists: an item closes those further in, and
    a line that is no item, unless it is indented as a part of one, closes all."""
    item = _ITEM.match(line)
    if item:
        indent = len(item.group(1))
        while stack and stack[-1] > indent:
            stack.pop()
        if not stack or stack[-1] < indent:
            stack.append(indent)
    elif line.strip() and not (stack and len(line) - len(line.lstrip()) > stack[-1]):
        stack.clear()
    return len(stack)


def split_levels(text: str) -> list[tuple[int, int, int]]:
    """As ``split``, with the list level of every sentence (0 outside lists)."""
    upper, lower = sum(map(str.isupper, text)), sum(map(str.islower, text))
    caseless = upper == 0 or lower == 0 or upper > 8 * lower
    out: list[tuple[int, int, int]] = []
    lists: list[int] = []
    level = 0

    def emit(a: int, b: int) -> None:
        s = text[a:b]
        left = len(s) - len(s.lstrip())
        if left < len(s):
            out.append((a + left, a + len(s.rstrip()), level))

    for ln in _LINE.finditer(text):
        line, base = ln.group(), ln.start()
        level = _list_level(line, lists)
        pairs = _matched(line) if re.search(r"[«“„「『(（\[【《〈\"]", line) else {}
        start, skip, i = 0, 0, 0
        while m := _MARK.search(line, i):
            i, ch = m.end(), m.group()
            if m.start() in pairs:  # down into the quotation or bracket and up again at its end
                close = pairs[m.start()]
                i = close + 1
                if ch in _BRACKETS or line[close - 1] not in _TERM:
                    continue
                led_in = line[start : m.start()].rstrip()
                i = _tail(line, i, pairs)
                nxt = line[i:].lstrip()[:1]
                if _CJK.match(line[close - 1]) and not led_in.endswith(("：", ":")):
                    ends = not nxt
                elif line[i:].lstrip()[:1] in tuple("-–—,;:"):
                    ends = False
                else:
                    ends = _starts(line, i, caseless) is not False and (not caseless or led_in.endswith(":") or not nxt)
                if ends:
                    emit(base + start, base + i)
                    start = i
                continue
            if ch[0] in _TERM:
                i = _tail(line, i, pairs)
                if ch[0] in "。！？｡" or ch[-1] in "。！？｡।॥" or _CJK.match(line[i : i + 1]) and ch != "." or _CJK.match(line[max(0, m.start() - 1) : m.start()]) and ch[0] == "…":
                    ends = line[i : i + 1] not in tuple("，,、；")
                else:
                    ends = _ends(line, start, m.start(), m.end(), i, caseless)
                if not ends:
                    i = m.end()
            elif ch[0] == " ":
                ends = True
            elif _EMOJI_ONLY.match(ch):
                i = _tail(line, i, pairs)
                ends = any(map(str.isalnum, line[start : m.start()])) and _starts(line, i, caseless) is not False
            else:
                continue
            if ends:
                emit(base + start, base + i)
                start = i
        emit(base + start, base + len(line))
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(i, k, s, e, t[s:e], level) for i, t in zip(b["record_id"], b["text"], strict=True) for k, (s, e, level) in enumerate(split_levels(t))]
        yield pd.DataFrame(out, columns=["record_id", "seq", "start_offset", "end_offset", "sentence", "list_level"])


def sentences(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """``record_id, seq, start_offset, end_offset, sentence, list_level`` of every text of ``df``; equal rows give theirs once.

    Without ``with_text`` only ``record_id, start_offset, end_offset``: then no text is shuffled, as what was split twice is
    made one by its offsets.
    """
    rows = df.select(F.col(key).cast("string").alias("record_id"), F.col(text).alias("text")).filter("record_id IS NOT NULL AND text IS NOT NULL")
    out = (rows.distinct() if with_text else spread(rows, "record_id")).mapInPandas(_rows, "record_id string, seq int, start_offset int, end_offset int, sentence string, list_level int")
    return out if with_text else out.select("record_id", "start_offset", "end_offset").distinct()
