"""Splitting text into blank-delimited chunks that a byte-level BPE encodes one by one."""

from __future__ import annotations

import re

#: The characters of the Unicode property White_Space, which ``\\s`` of the public split pattern stands for.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"

#: A run of other characters with at most one blank before it, or white space. No piece of the public split pattern reaches
#: over a chunk's end: white space before a word leaves its last character, and a blank goes with the word.
CHUNK = re.compile(rf" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]")
