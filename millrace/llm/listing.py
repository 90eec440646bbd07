"""What a single line or sentence shows: whether it states something or lists, links or repeats (for problem 9)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Common function words of the languages in the corpus.
FUNCTION_WORDS = frozenset(
    """
    the a an of to in on at for with and or but is are was were be been it its this that these those we our you your
    they their he she his her i my not no if when while though because so as by from than there who which what has have
    had do does did will would can may must after before until once about into how why where
    der die das ein eine einen einem einer und oder aber ist sind war waren im am an auf für mit von zu zum zur nicht wir
    uns sie ihr ihre ich mein meine wenn weil doch als bei nach vor aus dem den des es wie über durch hat haben noch
    el la los las un una unos unas de del y o pero es son fue en al con por para que no se su sus mi nos lo si cuando
    porque como más ya sin sobre hay ha han
    le les des du et ou mais est sont était à au aux avec par pour ne pas sa son ses nous vous il elle ils quand qui sur
    dans l d n s c ce cette plus tout
    """.split()
)

MARKUP = ("://", "www.", "](", "<a ", "href=")
ADDRESS = re.compile(r"\b[a-z0-9-]{4,}\.[a-z]{3,8}(?:/\S*|(?=[\s)\"|*,<]|$))")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NUMBER = re.compile(r"\d+")
SENTENCES = re.compile(r"(?<=[.!?…])[\"')\]]*\s+")
ITEMS = re.compile(r"[|»>•·;,/]| - | – |\s\*\s|\t|\(\d+\)")
CLOSERS = "'\")]» \t"

LISTED, STATED, OPEN, LOOSE = 1, 0, -1, -2


def plain(text: str) -> str:
    """The text with entities decoded and special spaces and line ends made plain."""
    return html.unescape(text).replace(" ", " ").replace("​", "").replace("\r\n", "\n").replace("\r", "\n")


def kind(unit: str, words: list[str]) -> int:
    """``LISTED``, ``STATED``, or without evidence ``OPEN`` (ends like a statement) or ``LOOSE`` for one line or sentence.

    Links list. So do units whose content words (numbers are such) keep coming back, long ones with next to no
    function words, and units that do not end like a statement: without any end mark, or asking and shouting with next to no function words. A
    statement has five words or more, function words among them, and ends with a full stop or colon.
    """
    dot = unit.find(".")
    if any([m in unit for m in MARKUP]) or (0 <= dot < len(unit) - 1 and ADDRESS.search(unit)):
        return LISTED
    n = len(words)
    content = [w for w in words if w not in FUNCTION_WORDS]
    c = len(content)
    share = (n - c) / n if n else 0.0
    again = c - len(set(content))
    if again >= 2 and share < 0.5 and again >= 0.3 * (c + len(NUMBER.findall(unit))):
        return LISTED
    if n >= 12 and share < 0.12:
        return LISTED
    end = unit.rstrip(CLOSERS)[-1:]
    if end and end in ".…:;":
        return STATED if n >= 5 and share >= 0.2 else OPEN
    if n and share < 0.12:
        return LISTED
    return LOOSE if n < 5 or end in "!?" else LISTED


def pieces(text: str | None) -> Iterator[tuple[list[str], int, bool, bool]]:
    """The items of a text in order: ``(words, characters, listed, decided)``.

    Units are lines and sentences, items what separators part in them. An open unit follows the larger
    part of its paragraph; where that says nothing it is a statement, and ``decided`` is false. Three or more
    loose units (questions, short lines) that outweigh the statements of their paragraph are a list, undecided too.
    """
    if not text:
        return
    paragraph: list[tuple[list[tuple[list[str], int]], int, int]] = []

    def settle() -> Iterator[tuple[list[str], int, bool, bool]]:
        weight = {LISTED: 0, STATED: 0, OPEN: 0, LOOSE: 0}
        for _, size, k in paragraph:
            weight[k] += size
        told = weight[STATED] + weight[OPEN]
        loose = weight[LOOSE] > told and sum(k == LOOSE for _, _, k in paragraph) >= 3
        mostly = weight[LISTED] > weight[STATED]
        looks = {LISTED: True, STATED: False, OPEN: mostly, LOOSE: loose or mostly}
        for items, _, k in paragraph:
            for words, size in items:
                yield words, size, looks[k], k >= 0
        paragraph.clear()

    for line in plain(text).split("\n"):
        line = line.strip()
        if not line:
            yield from settle()
            continue
        for unit in SENTENCES.split(line):
            if not unit:
                continue
            items = [(WORD.findall(x.lower()), len(x)) for x in ITEMS.split(unit)]
            items = [x for x in items if x[0]]
            every = items[0][0] if len(items) == 1 else [w for ws, _ in items for w in ws]
            paragraph.append((items or [([], len(unit))], len(unit), kind(unit, every)))
    yield from settle()
