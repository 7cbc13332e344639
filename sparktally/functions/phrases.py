"""Sentences, tokens, material phrases and file names as columns.

Blanks, digits and word boundaries are ASCII's, but for tokens, whose letters
and digits are Unicode's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# References that a full stop may follow without ending a sentence.
REFERENCES = [
    r"(?i:\bIS\s*\d+)",
    r"\bNo\.\s*\d+",
    r"\bSr\.\s*\d+",
    r"\bFig\.\s*\d+",
    r"\bCl\.\s*\d+",
    r"(?i:\bClause\s+\d+)",
    r"(?i:\bSection\s+\d+)",
    r"(?i:\bArticle\s+\d+)",
    r"(?i:\bItem\s+\d+)",
    r"(?i:\bASTM\s+\w+\s*\d+)",
    r"(?i:\bBS\s+\d+)",
    r"(?i:\bEN\s+\d+)",
    r"(?i:\bISO\s+\d+)",
]
DECIMAL = r"\b\d+\.\d+\b"
SENTENCE_END = r"""([.!?])(\s+)([A-Z"'(])"""
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"

# What a material phrase loses at its start and end, in order.
ACTIONS = [
    r"supply\s*(?:&|and)\s*application\s+of\s+",
    r"supply\s*,?\s*installation\s*,?\s*testing\s*,?\s*and\s+commissioning\s+of\s+",
    r"supply\s+installation\s+testing\s+commissioning\s+of\s+",
    r"supply\s*,?\s*installation\s+of\s+",
    r"supply\s+and\s+installation\s+of\s+",
    r"testing\s+and\s+commissioning\s+of\s+",
    r"supplying\s+and\s+fixing\s+",
    r"supplying\s+and\s+applying\s+",
    r"providing\s+and\s+fixing\s+",
    r"providing\s+and\s+supplying\s+",
    r"providing\s*,?\s*supplying\s*,?\s*and\s+fixing\s+",
    r"providing\s+and\s+installation\s+of\s+",
    r"providing\s+and\s+laying\s+",
    r"fabrication\s*,?\s*supplying\s+and\s+installation\s+of\s+",
    r"supplying\s+",
    r"providing\s+",
    r"supply\s+",
    r"providing\s+&?\s+",
    r"supplyinstallationof\s+",
    r"supplyandinstallationof\s+",
    r"testingandcommissioningof\s+",
    r"supply,?\s*installation\s*and\s*testing\s*of",
]
CLOSINGS = [
    r"\s+of\s+as\s+per\s+schedule[\-\s]?[a-z0-9]*\.?.*$",
    r"\s+as\s+per\s+schedule[\-\s]?[a-z0-9]*\.?.*$",
    r"\s+per\s+schedule[\-\s]?[a-z0-9]*\.?.*$",
    r"\s+as\s+per\s+instruction\s+of\s+engineer\s+in[\-\s]?charge.*$",
    r"\s+as\s+per\s+instructions?\s+of\s+(?:the\s+)?(?:site\s+)?(?:engineer|supervisor).*$",
    r"\s+as\s+per\s+general\s+terms?\s+(?:&|and)\s+conditions?.*$",
    r"\s+as\s+per\s+terms?\s+(?:&|and)\s+conditions?.*$",
    r"\s+general\s+terms?\s+(?:&|and)\s+conditions?\s+and\s+instructions?.*$",
    r"\s+of\s+general\s+terms?\s+(?:&|and)\s+conditions?.*$",
    r"\s+as\s+per\s+approved\s+guidelines.*$",
    r"\s+as\s+per\s+specifications?.*$",
    r"\s+as\s+per\s+drawings?.*$",
    r"\s+as\s+per\s+direction\s+of\s+engineer.*$",
    r"\s+as\s+per\s+site\s+conditions?.*$",
    r"\s+as\s+directed\s+by\s+engineer.*$",
    r"\s+including\s+adhesive\s+required\s+for\s+insulation\s+application.*$",
    r"\s+with\s+all\s+accessories.*$",
    r"\s+complete\s+in\s+all\s+respects?.*$",
    r"\s+per\s+schedule\s*$",
    r"\s+etc\.?\s*$",
]
LEADING = [
    r"^\s*\d+(?:\.\d+)?\s*(?:mm|cm|m|inch|in)\s+thick\s+",
    r"^\s*\d+(?:\.\d+)?\s*(?:mm|cm|m|inch|in)\s+dia(?:meter)?\s+",
    r"^\s*lightly\s+(?:resin\s+)?bonded\s+",
    r"^\s*resin\s+bonded\s+",
    r"^\s*self\s+",
    r"^\s*type\s+[a-z0-9\-]+\s+",
    r"^\s*grade\s+[a-z0-9\-]+\s+",
    r"^\s*first\s+layer\s+of\s+",
    r"^\s*second\s+layer\s+of\s+",
    r"^\s*closed\s+cell\s+",
    r"^\s*open\s+cell\s+",
    r"^\s*density\s+\d+\s*(?:to\s+\d+\s*)?(?:kg|g|lb)/(?:m[23]|cubic\s*m(?:eter|etre)?)\s+",
    r"^\s*having\s+density\s+.*?\s+kg/(?:m[23]|cubic\s*m(?:eter|etre)?)\s+",
    r"^\s*with\s+minimum\s+(?:stc|nrc|density)\s+.*?\s+d[bp]?\s+",
    r"^\s*fm\s+approved\s+",
    r"^\s*armaflex\s+",
]
TRAILING = [
    r"\s+of\s+(?:[\d\.]+\s*)?mm\s+thickness\s*$",
    r"\s+having\s+density\s+.*$",
    r"\s+density\s+.*$",
    r"\s+with\s+.*$",
    r"\s+on\s+\d+(?:\.\d+)?\s*NB\s+(?:to|/|-)\s+.*$",
]
#: Strips and cuts that would leave less than this are not made.
SHORTEST, LONGEST, ROUNDS = 15, 200, 5
EDGES = " ,.;:-"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Array of the sentences of a text; null and blank texts have none.

    A sentence ends at '.', '!' or '?' before white space and a capital, quote or
    bracket, unless a reference (IS 456, Clause 7) ends there. After a decimal
    number no sentence ends any more. U+0001 counts as white space."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\x01", " ")
    decimal = F.regexp_instr(plain, F.lit(DECIMAL))
    head = F.when(decimal > 0, F.substring(plain, F.lit(1), decimal - 1)).otherwise(plain)
    tail = F.when(decimal > 0, F.substring(plain, decimal, F.length(plain))).otherwise("")
    ends = F.regexp_replace(head, SENTENCE_END, "$1\x01$2$3")
    kept = F.regexp_replace(ends, f"({'|'.join(REFERENCES)})([.!?])\x01", "$1$2")
    return F.filter(F.transform(F.split(F.concat(kept, tail), "\x01"), stripped), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, and single other characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def _first(text: Column, patterns: list[str], change, otherwise: Column) -> Column:
    """change(text, pattern) of the first pattern for which it is not null."""
    return F.coalesce(*(change(text, f"(?i){p}") for p in patterns), otherwise)


def _before(text: Column, pattern: str, shortest: int = 1) -> Column:
    """What precedes a pattern's first match, if that has `shortest` characters."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > shortest, F.substring(text, F.lit(1), at - 1))


def _without(text: Column, pattern: str, shortest: int = 0) -> Column:
    """Text without a pattern's match, if that changes it and leaves enough."""
    left = F.regexp_replace(text, pattern, "")
    return F.when((left != text) & (F.length(stripped(left)) >= shortest), left)


def _rounds(text: Column, patterns: list[str], shortest: int) -> Column:
    """Up to ROUNDS times the first pattern that applies; every round is an
    element's function, so that its text is computed once."""
    step = lambda t, _: _first(t, patterns, lambda x, p: _without(x, p, shortest), t)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), text, step)


def _shortened(text: Column) -> Column:
    at = F.regexp_instr(text, F.lit("[.;]"))
    whole = F.when(at > SHORTEST, F.substring(text, F.lit(1), at - 1))
    cut = _first(text, CLOSINGS, lambda x, p: _before(x, p, SHORTEST), F.substring(text, 1, LONGEST))
    return F.when(F.length(text) > LONGEST, F.coalesce(whole, cut)).otherwise(text)


def material_phrase(sentence: Column) -> Column:
    """The material that a work item's sentence names: without the action before
    it, references after it, sizes and grades around it, and cut at a sentence's
    end beyond LONGEST characters. Null and blank sentences give ''."""
    steps = [
        lambda t: F.regexp_replace(t, f"(?i)^(?:{'|'.join(ACTIONS)})", ""),
        lambda t: _first(t, CLOSINGS, _before, t),
        lambda t: F.transform(F.array(_rounds(t, LEADING, SHORTEST)), lambda x: F.when(F.length(stripped(x)) < SHORTEST, t).otherwise(x))[0],
        lambda t: _rounds(t, TRAILING, 0),
        _shortened,
        lambda t: F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(EDGES)),
    ]
    # Each step sees the one before as an array element: one evaluation, however often it is named.
    return reduce(lambda held, f: F.transform(held, f), steps, F.array(stripped(F.coalesce(sentence, F.lit("")))))[0]


def catalog_text(text: Column) -> Column:
    """Lower case, single blanks, and o for 0 in words that have other letters."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+", " ")), " ")
    mixed = lambda w: F.translate(w, "o", "").rlike(r"\p{L}")
    return F.array_join(F.transform(words, lambda w: F.when(mixed(w), F.translate(w, "0", "o")).otherwise(w)), " ")


def names_file(doc_id: Column, path: Column) -> Column:
    """Whether a document's id, with or without a last bracket, is the name of a
    file without its suffix or of the folder that holds it. Empty: false."""
    folder = F.regexp_extract(path, r"([^/]+)/+[^/]+/*$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), r"(?<=.)\.[^.]+$", "")
    bare = F.regexp_replace(doc_id, r"\s*\([^)]*\)$", "")
    named = F.lit(False)
    for name in (doc_id, bare):
        named = named | ((name != "") & ((name == folder) | (name == stem)))
    return F.coalesce((doc_id != "") & (path != "") & named, F.lit(False))
