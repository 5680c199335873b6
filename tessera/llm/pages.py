"""What a page is made of: content and link features for the trees, and, read part by part, the shares of sentences, of
data and of neither, which give weak labels and the last check. The two share no signal: the features know no
words and no sentences, the shares no counts of marks, repeats or hosts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

# Common function words of the languages the pages are written in.
FUNCTION_WORDS = frozenset(
    """a an and are as at be because been before between but by can could did do does for from had has have here how
    if in into is it its more most my nor not of on only or our out over should so some such than that the their them
    then there these they this to too under until up upon was we were what when where whether which while who whose
    why will with without would you your
    aber als am an auch auf aus bei bis damit dann das dass dem den der des die dies diese dieser doch durch ein eine
    einem einen einer eines er es für gegen hat haben ihr im ist ja jedoch kein keine man mehr mit nach nicht noch nun
    nur ob oder ohne sehr sein sich sie sind so über um und unter vom von vor war warum waren was weil wenn wer wird
    wurde wurden zu zum zur
    au aucun aucune aux avec car ce ces cet cette comme dans de depuis des donc dont du elle en est et été il ils je la
    le les leur mais même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur un une vers
    al algo ante como con cuando del desde donde el ella en entre era esta este estos fue ha hasta hay la las lo los más
    muy ni ninguna ninguno no nos para pero por porque qué quien se según ser si sin sobre su sus también tras una y ya
    без был была были в во вот для до его ее если же за из или их к как ко ли лишь между мы на не ни но о об он она они
    от по под после при с со так также только у уже что чтобы это""".split()
)

_WORD = re.compile(r"[^\W\d_]+")
_MAYBE_LINK = re.compile(r"://|[a-z0-9]\.[a-z]{2}")
_LINK = re.compile(r"(?:[a-z]+://|www\.)\S+|(?<![\w.-])[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{3,8}(?![\w.])(?:[/?]\S*)?", re.I)
_CUT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[|•★·]+")
_CHAIN = re.compile(r"[A-Z]{25,}")
_ROW = re.compile(r"[^;|,\t\n]{1,40}?(?:[;|,\t]| {2,}) *[^;|,\t\n ]{1,20} *(?:[;|,\t]| {2,}) *(?:[<>~=]? ?\d+(?:\.\d+)?|n/?a|-) *(?:[;|,\t]| {2,}) *(?:\d{1,2}(?:\.\d)?|n/?a|-)(?!\d)")
_STRUCTURE = re.compile(r"(?:[BCNOPSFIbcnops]|Cl|Br|\[[^\]\s]{1,12}\]|[-=#()0-9%/\\@+.:]){12,}")
_DENSE = re.compile("[぀-ヿ㐀-鿿]")
_PARTICLE = re.compile("[的了在是为被和与未不个はをにがのでとした]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_END = re.compile(r"[.!?。！？:;)…]['\"”»)]*\s*$")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")

FEATURES = [
    *"stops commas bars hashes semicolons dashes slashes parens tabs digits upper stars dots odd".split(),
    *"words letters_apart distinct top_words line_length distinct_lines links link_hosts in_links".split(),
]
_STOPS = ("。", "！", "？", ". ", "! ", "? ", ".\n", "!\n", "?\n")
#: Sets of ASCII characters, as rows of zeros and ones.
_SETS = np.array([[chr(i) in m for i in range(128)] for m in (",", "|", "#", ";", "-", "/", "[]()", "\t", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")], np.float64)
_HOST = re.compile(r"(?:[^/@\s]*@)?(?:www\.)?([^/:?#\s\"'<>()\]]+)", re.I)
_BARE = re.compile(r"(?<![/@])\bwww\.([^/:?#\s\"'<>()\]]+)")


def linked_hosts(text: str) -> list[str]:
    """Hosts of all links of a page without ``www.``, in lower case, one per link."""
    found = [m[1].lower() for part in text.split("://")[1:] if (m := _HOST.match(part))]
    return found + _BARE.findall(text.lower()) if "www." in text else found


def content(text: str) -> tuple[list[float], list[str]]:
    """The FEATURES of a text but for ``in_links``, which is the host graph's, and the distinct hosts it links to.

    Marks are counted from one histogram of the characters; words are what blanks part.
    """
    n = max(1, len(text))
    if text.isascii():
        codes, odd, stars, dots = np.frombuffer(text.encode(), np.uint8), 0.0, 0, 0
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = codes[codes < 128]
        odd, stars, dots = (n - len(codes)) / n, text.count("★"), text.count("·") + text.count("•") + text.count("–")
    marks = _SETS @ np.bincount(codes, minlength=128)
    words = text.lower().split()
    many = max(1, len(words))
    seen = Counter(words)
    lines = text.split("\n")
    hosts = linked_hosts(text)
    known = sorted(set(hosts))
    per = 100 / n
    return [
        sum(map(text.count, _STOPS)) * per,
        *(marks * per).tolist(),
        stars * per,
        dots * per,
        odd,
        len(words) * per,
        sum(c for w, c in seen.items() if len(w) == 1) / many,
        len(seen) / many,
        sum(sorted(seen.values())[-5:]) / many,
        min(400.0, n / len(lines)),
        len(set(lines)) / len(lines),
        len(hosts) * 1000 / n,
        len(known) / max(1, len(hosts)),
    ], known


def _marked(line: str) -> int:
    return max(map(line.count, (";", "|", "\t", ",", "  ")))


def _rows(line: str) -> int:
    """Characters in rows of a table, looked for only where one kind of field mark is frequent."""
    marks = _marked(line)
    if marks < 3 or marks * 16 < len(line) or "★" in line:
        return 0
    return sum(len(m) - m.count(" ") for m in _ROW.findall(line))


def is_sentence(part: str, words: list[str], function: int) -> bool:
    """Whether a part of a line reads as a sentence: it has function words, or the particles of a script
    without spaces, and isn't the same word again and again."""
    n = len(words)
    if not part.isascii():
        if len(_DENSE.findall(part)) >= 5:
            return _PARTICLE.search(part) is not None
        if n >= 4 and _CYRILLIC.search(part) and _END.search(part):
            return len(set(words)) * 3 > 2 * n
    if n < 4 or function * 8 < n or not function or len("".join(words)) < 2.5 * n:
        return False
    # Without an end mark a part is long and rich in function words, or a phrase with some in it.
    if _END.search(part) is None and (n < 7 or function * 5 < n):
        return False
    return len(set(words)) * 2 > n


def shares(text: str) -> tuple[float, float, float]:
    """Shares of sentences, of data and of neither, of a text's characters without blanks."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    total = sentences = data = 0
    lines = text.split("\n")
    for at, line in enumerate(lines):
        if not line or line.isspace():
            continue
        size = len(line) - line.count(" ")
        if (line.isupper() and line.isalpha() and size > 5) or (line[0] == ">" and size < 120):
            total += size
            data += size
            continue
        rows = _rows(line)
        if not rows and len(line) < 80 and at + 1 < len(lines) and _marked(line) >= 3 and _rows(lines[at + 1]) * 2 > len(lines[at + 1]) - lines[at + 1].count(" "):
            rows = size  # the heads of a table's columns
        if rows * 2 > size:
            total += size
            data += size
            continue
        if _MAYBE_LINK.search(line):
            plain = _LINK.sub(" ", line)
            total += size - (len(plain) - plain.count(" "))
            line = plain
        for part in _CUT.split(line):
            size = len(part) - part.count(" ")
            if not size:
                continue
            total += size
            words = _WORD.findall(part.lower())
            function = len(words) - len([w for w in words if w not in FUNCTION_WORDS])
            if is_sentence(part, words, function):
                sentences += size
            elif size >= 12:
                chains = _CHAIN.findall(part)
                data += min(size, sum(map(len, chains)) + sum(map(len, _STRUCTURE.findall(part))) + _rows(part))
    total = max(total, 1)
    return sentences / total, data / total, max(0.0, 1 - (sentences + data) / total)
