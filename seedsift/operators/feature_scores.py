"""Feature scores: how well a term tells a class from the rest.

Every score is one SQL expression over the counts of a (class, term) pair. ``ig`` is the active
one of the reference, the others are its switchable schemes.

Columns read here: ``p``, ``n`` occurrences in and outside the class (n already smoothed),
``nc`` class documents (smoothed with n), ``class_docs`` class documents as labelled, ``total``,
``log_likelihood``, and for the collection based scores ``df`` and ``n_docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions.ieee import (
    binomial_log_likelihood,
    ieee_div,
    ieee_log,
    x_log_x,
    x_log_x_over,
)


def with_probabilities(counts: DataFrame, collection_pt: bool = False) -> DataFrame:
    """The contingency probabilities of class and term.

    With ``collection_pt`` the share of documents that contain the term replaces P(t) in the
    mutual information scores; information gain keeps the trained one (``pt``).
    """
    ratios = {
        "pc": ("nc", "total"),
        "pt": ("p + n", "total"),
        "pt_used": ("df", "n_docs") if collection_pt else ("p + n", "total"),
        "pc_t": ("p", "p + n"),
        "pnc_t": ("n", "p + n"),
        "pc_nt": ("nc - p", "total - (p + n)"),
        "pnc_nt": ("total - (nc + n)", "total - (p + n)"),
        "ptc": ("p", "total"),
        "ptnc": ("n", "total"),
        "pntc": ("nc - p", "total"),
        "pntnc": ("total - (nc + n)", "total"),
    }
    return counts.selectExpr(
        "*", *[f"{ieee_div(*ratio)} AS {name}" for name, ratio in ratios.items()]
    ).selectExpr("*", "1D - pc AS pnc", "1D - pt AS pnt")


def information_gain(nan_policy: str = "ieee") -> str:
    def h(x: str) -> str:
        return x_log_x(x, nan_policy)

    return (
        f"-{h('pc')} - {h('pnc')} + pt * ({h('pc_t')} + {h('pnc_t')})"
        f" + pnt * ({h('pc_nt')} + {h('pnc_nt')})"
    )


def _cell(joint: str, klass: str, term: str) -> str:
    """ln of a joint probability over the product of its margins."""
    return ieee_log(ieee_div(joint, f"{klass} * {term}"))


def _pointwise(joint: str, klass: str) -> str:
    """The same with the logarithms taken one by one."""
    return f"({ieee_log(joint)} - ({ieee_log(klass)} + {ieee_log('pt_used')}))"


_INSIDE = _cell("ptc", "pc", "pt_used")
_OUTSIDE = _cell("ptnc", "pnc", "pt_used")


def _entropy(*cells: str) -> str:
    parts = " + ".join(x_log_x_over(cell, "total") for cell in cells)
    return f"({ieee_log('total')} - ({parts}))"


def likelihood_ratio(other_count: str, other_size: str) -> str:
    """Two sample likelihood ratio of the class against a second sample."""
    own, other = ("p", "class_docs"), (other_count, other_size)
    pooled = (f"p + {other_count}", f"class_docs + {other_size}")
    return (
        f"{binomial_log_likelihood(*other, *pooled)} + {binomial_log_likelihood(*own, *pooled)}"
        f" - {binomial_log_likelihood(*own, *own)} - {binomial_log_likelihood(*other, *other)}"
    )


FEATURE_SCORES: dict[str, str] = {
    "odds": f"{ieee_log('p')} - {ieee_log('n')}",
    "mi_ratio": ieee_div("p * total", "(p + (class_docs - p)) * (p + n)"),
    "freq": "p + n",
    "mi": f"ptc * {_INSIDE} + ptnc * {_OUTSIDE}"
    f" + pntc * {_cell('pntc', 'pc', 'pnt')} + pntnc * {_cell('pntnc', 'pnc', 'pnt')}",
    "mi_term": f"ptc * {_INSIDE} + ptnc * {_OUTSIDE}",
    "mi_classweighted": f"pc * {_INSIDE} + pnc * {_OUTSIDE}",
    "mi_max": f"greatest(pc * {_INSIDE}, pnc * {_OUTSIDE})",
    "mi1": _pointwise("ptc", "pc"),
    "mi2": f"ptc * {_pointwise('ptc', 'pc')} + ptnc * {_pointwise('ptnc', 'pnc')}",
    # H(class) + H(term) - H(class, term). The reference's disabled formula adds the joint
    # entropy; mutual information subtracts it.
    "mi3": f"{_entropy('class_docs', 'total - class_docs')} + {_entropy('p + n', 'total - (p + n)')}"
    f" - {_entropy('p', 'n', 'class_docs - p', '(total - class_docs) - n')}",
    "df": f"{ieee_log('df')} - n_docs",
    "ll": "log_likelihood",
    "lr1": likelihood_ratio("n", "(total - class_docs)"),
    "lr2": likelihood_ratio("df", "n_docs"),
    "lr3": likelihood_ratio("(p + n)", "total"),
}

NEEDS_COLLECTION = {"df", "lr2"}


def feature_score(name: str, nan_policy: str = "ieee") -> Column:
    return F.expr(information_gain(nan_policy) if name == "ig" else FEATURE_SCORES[name])
