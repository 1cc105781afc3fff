"""Repair of recognised texts that lost or split characters of names. Substitutions here depend on a vocabulary at each match, which no
built-in function does, so this is an Arrow function over batches; the vocabulary is configuration of a few thousand words and goes with it."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is lost at the beginning of which names, in which surroundings.
DIRECT = {
    "ACAT": ("FACAT", r"\bDISEASE\s+CHARACTERISTICS\b|\bCROHN|\bULCERATIVE\b"),
    "AOBJ": ("FAOBJ", r"\bFEVER\b|\bCROHN|\bDISEASE\b"),
    "AORRES": ("FAORRES", r"\bFATESTCD\b"),
    "OSCAT": ("QSCAT", r"\bIBDQ\b"),
    "SORRES": ("VSORRES", r"\bVSTESTCD\b|\bVSORRESU\b|\bSYSBP\b|\bDIABP\b"),
    "SSTAT": ("RSSTAT", r"\bRSTESTCD\b|\bRSALL\b"),
    "STERM": ("DSTERM", r"\bDSDECOD\b|\bVOLUNTARY\b|\bWITHDRAWAL\b"),
    "UOCCUR": ("SUOCCUR", r"\bFORMER\b|\bCURRENT\b|\bSUST"),
    "USTRTPT": ("SUSTRTPT", r"\bFORMER\b|\bCURRENT\b|\bSUST"),
}
PREFIXES = {
    "F": (r"\bFATESTCD\b|\bFAORRES\b|\bFAOBJ\b|\bFACAT\b|\bFASCAT\b", "FA"),
    "V": (r"\bVSTESTCD\b|\bVSORRES\b|\bVSORRESU\b|\bSYSBP\b|\bDIABP\b", "VS"),
    "R": (r"\bRSTESTCD\b|\bRSALL\b|\bRSCAT\b", None),
    "D": (r"\bDSDECOD\b|\bDSTERM\b|\bDISPOSITION\b", None),
    "S": (r"\bSUST|\bSUCAT\b|\bTOBACCO\b|\bFORMER\b|\bCURRENT\b", None),
    "Q": (r"\bIBDQ\b|\bQSCAT\b|\bQUESTIONNAIRE\b", None),
}
DRIFTED = ["QONAM", "ONAM", "INAM", "JNAM", "QDNAM"]
BEFORE_AM = ["QO", "QD", "QN", "ON", "IN", "JN"]


def squeeze(text: str | None) -> str:
    return re.sub(r"\s{2,}", " ", re.sub(r"[\r\n]", " ", text or "")).strip()


class Repairer:
    """variables, datasets: upper-case vocabulary terms. Indexes by deletion and by tail answer without going over the vocabulary."""

    def __init__(self, variables: list[str], datasets: list[str] = ()):
        self.variables, self.known = frozenset(variables), frozenset(variables) | frozenset(datasets)
        self.by_cut, self.by_tail = defaultdict(set), defaultdict(list)
        for v in self.variables:
            for cut in self._cuts(v):
                self.by_cut[cut].add(v)
            self.by_tail[v[1:]].append(v)
        self.nearest = lru_cache(1 << 16)(self._nearest)

    @staticmethod
    def _cuts(word: str) -> set[str]:
        return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}

    @staticmethod
    def _within_one(a: str, b: str) -> bool:
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 1 :] == b[i + 1 :]

    def _nearest(self, word: str) -> str:
        """The only variable within one edit, or ''."""
        found = {v for cut in self._cuts(word) for v in self.by_cut.get(cut, ()) if self._within_one(word, v)}
        return found.pop() if len(found) == 1 and word else ""

    def fix(self, token: str, context: str, neighbour: str = "") -> str:
        """token and context in upper case: the variable that the token probably was, else the token."""
        if not token or token in self.variables:
            return token
        target, around = DIRECT.get(token, ("", ""))
        if target in self.variables and re.search(around, context):
            return target
        likely = [p for p, (around, start) in PREFIXES.items() if re.search(around, context) or (start and neighbour.startswith(start))]
        longer = sorted(self.by_tail.get(token, ()))
        prefixed = next((p + token for p in likely if p + token in self.variables), "")
        return prefixed or self.nearest(token) or (longer[0] if len(longer) == 1 else token)

    def repair(self, text: str | None) -> str:
        out = squeeze(text)
        for _ in range(2):
            out = re.sub(r"\b([A-Z][A-Z0-9]{0,3})\s+([A-Z0-9]{1,7})\b", self._merged, out)
        supp = bool(re.search(r"\bSUPP[A-Z]{2,8}\b", out, re.IGNORECASE))
        if supp:
            out = re.sub(rf"\b(?:{'|'.join(DRIFTED)})\s*=", "QNAM=", out, flags=re.IGNORECASE)
        out = re.sub(r"\b([A-Z]{2,6})\s+([A-Z]{2,8})\s*=", lambda m: self._split_name(m, supp), out)
        context = out.upper()

        def fixed(m: re.Match, end: str) -> str:
            name = m[1].upper()
            new = self.fix(name, context)
            return m[0] if new == name else new + end

        out = re.sub(r"\b([A-Z][A-Z0-9]{1,7})\s*=", lambda m: fixed(m, "="), out)
        out = re.sub(r"\b([A-Z][A-Z0-9]{1,7})\s+(?=(?:when|if|then)\b)", lambda m: fixed(m, " "), out, flags=re.IGNORECASE)

        def pair(m: re.Match) -> str:
            new = (self.fix(m[1], context, m[2]), self.fix(m[2], context, m[1]))
            return m[0] if new == (m[1], m[2]) else "/".join(new)

        return squeeze(re.sub(r"\b([A-Z][A-Z0-9]{1,7})/([A-Z][A-Z0-9]{1,7})\b", pair, out))

    def _merged(self, m: re.Match) -> str:
        whole = m[1] + m[2]
        return whole if len(whole) <= 8 and whole in self.known else m[0]

    def _split_name(self, m: re.Match, supp: bool) -> str:
        left, right, whole = m[1], m[2], m[1] + m[2]
        if len(whole) > 8:
            return m[0]
        if supp and (right in DRIFTED or (right == "AM" and left in BEFORE_AM)):
            return "QNAM="
        name = whole if whole in self.variables else self.nearest(whole)
        return f"{name}=" if name else m[0]


def repair(c: Column, variables: list[str], datasets: list[str] = ()) -> Column:
    """The text with repaired names; null gives ''."""
    made: list[Repairer] = []

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Repairer(variables, list(datasets)))
        return texts.map(made[0].repair)

    return run(c)
