"""Measures that are loops by nature, as Arrow functions."""

from __future__ import annotations

import base64
import hashlib
import hmac
import html
import html.entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

THRESHOLD, LEAST = 0.72, 20
_TOKEN = re.compile(r"\b[\w']+\b")


def _lengths_per_factor(ids: np.ndarray, threshold: float) -> float:
    """Tokens divided by factors: stretches in which the share of distinct tokens falls to the threshold.

    before holds where each token stood last; in a stretch from `start` on, a token is new where that is before start.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    before = np.full(n, -1)
    before[order[same + 1]] = order[same]
    factors, start, look = 0.0, 0, 64
    while start < n:
        share = np.cumsum(before[start : start + look] < start) / np.arange(1, min(look, n - start) + 1)
        low = np.flatnonzero(share <= threshold)
        if len(low):
            factors, start, look = factors + 1, start + int(low[0]) + 1, 64
        elif start + look < n:
            look *= 2
        else:
            factors, start = factors + (1 - share[-1]) / (1 - threshold), n
    return n / factors if factors else float(n)


def lexical_diversity(text: str | None, threshold: float = THRESHOLD) -> float | None:
    """MTLD, the mean of both directions; None for fewer than 20 tokens."""
    words = _TOKEN.findall((text or ""))
    if len(words) < LEAST:
        return None
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w.lower(), len(known)) for w in words), np.int64, len(words))
    return float(_lengths_per_factor(ids, threshold) + _lengths_per_factor(ids[::-1], threshold)) / 2


@F.pandas_udf(DoubleType())
def mtld(text: pd.Series) -> pd.Series:
    return text.map(lexical_diversity)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded."""
    return text.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def decoded_closed(text: str) -> str:
    """Character references with their semicolon decoded; any other ampersand stays, a cut reference's too."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0], text)


@F.pandas_udf(StringType())
def unescape_closed(text: pd.Series) -> pd.Series:
    return text.map(decoded_closed, na_action="ignore")


def address_hash(salt: str):
    """A column function: what stands for an address in the log, 22 characters of its keyed SHA-256; null stays null."""

    @F.pandas_udf(StringType())
    def hashed(address: pd.Series) -> pd.Series:
        one = lambda x: base64.urlsafe_b64encode(hmac.new(salt.encode(), x.encode(), hashlib.sha256).digest())[:22].decode()
        return address.map(one, na_action="ignore")

    return hashed
