"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import html
import re
import unicodedata

INVISIBLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]"
)
INLINE_TAG = re.compile(r"</?(?:a|abbr|b|bdi|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|wbr)\b[^<>]*>", re.I)
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,200}>", re.S)
LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*\)")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """``text`` without markup and invisible characters, compatibility forms folded, case kept."""
    if "<" in text:
        text = TAG.sub(" ", INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = LINK.sub(r"\1", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return text


def words(text: str) -> list[str]:
    """Case-folded runs of letters and digits of :func:`plain` text."""
    return WORD.findall(plain(text).casefold())
