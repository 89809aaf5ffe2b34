"""Matching raw predictor names to their WoE and logit columns."""

from __future__ import annotations

from collections.abc import Callable

#: The affixes by which transformed columns are known.
WOE_AFFIXES = ("_woe", "woe_")
VAL_AFFIXES = ("_val", "_lin", "val_", "lin_")


def _norm(name: str) -> str:
    return str(name).strip().lower()


def looks_like_woe_column(name: str) -> bool:
    return _norm(name).endswith("_woe")


def looks_like_val_column(name: str) -> bool:
    return _norm(name).endswith(("_val", "_lin"))


def strip_affix(name: str, affixes: tuple[str, ...]) -> str:
    """``name`` in lower case without one leading or trailing affix."""
    text = _norm(name)
    for a in affixes:
        if a.startswith("_") and text.endswith(a) and len(text) > len(a):
            return text[: -len(a)]
        if a.endswith("_") and text.startswith(a) and len(text) > len(a):
            return text[len(a) :]
    return text


def _match(raw: list[str], transformed: list[str], affixes: tuple[str, ...]) -> dict[str, str]:
    """One pass a rule, from the strictest: same stem, stem after stripping both, one a prefix of the other.

    A transformed column serves one predictor; a rule that finds several for a predictor gives none.
    """
    free, found = list(dict.fromkeys(transformed)), {}
    stem = lambda c: strip_affix(c, affixes)
    rules: list[Callable[[str, str], bool]] = [
        lambda p, w: w == p,
        lambda p, w: stem(w) == _norm(p),
        lambda p, w: stem(w) == stem(p),
        lambda p, w: stem(w).replace("_", "") == stem(p).replace("_", ""),
        lambda p, w: stem(w).startswith(stem(p) + "_") or stem(p).startswith(stem(w) + "_"),
        lambda p, w: stem(p) in stem(w) or stem(w) in stem(p),
    ]
    for rule in rules:
        for p in raw:
            if p not in found:
                hits = [w for w in free if rule(p, w)]
                if len(hits) == 1:
                    found[p] = hits[0]
                    free.remove(hits[0])
    return {p: found[p] for p in raw if p in found}


def map_pred_to_woe(cols_pred: list[str], cols_pred_woe: list[str]) -> dict[str, str]:
    return _match(list(cols_pred or []), list(cols_pred_woe or []), WOE_AFFIXES)


def map_pred_to_val(cols_pred: list[str], cols_pred_val: list[str]) -> dict[str, str]:
    return _match(list(cols_pred or []), list(cols_pred_val or []), VAL_AFFIXES)
