"""Plans of natural-language queries: weighted terms, concepts and phrases, adapted to what the corpus holds.

Planning is plain Python over a batch of queries. It asks for document frequencies twice, each time once for the whole
batch: of the terms as written, and of the candidates for those that the corpus lacks.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from docfathom.functions import wordlists as W

_ASCII = re.compile(r"[a-z0-9][a-z0-9_.-]*")
_GLUED = re.compile(r"(?<![a-z0-9])(\d+)\s*[-_]?\s*([a-z]{2,})")
_CJK = re.compile(r"[一-鿿]+")
_BREAK = re.compile(W.CJK_BREAK)
#: Weights of terms by where they come from.
SYNONYM, BIGRAMS, CAMEL, STEM, TAIL, EDIT, ALIAS_EDIT, PREFIX, CARRIED = 0.2, 0.35, 0.55, 0.75, 0.45, 0.7, 0.8, 0.65, 0.85
#: What makes a query one about an error.
ERRORISH = re.compile(r"(?i)error|fail|denied|cannot|unable|exception|报错|失败|错误")
STAGES = frozenset("synonym segment identifier phrase typo prefix".split())


@dataclass
class Concept:
    """One thing the query asks for: the terms that show it, and how many of them a document must have."""

    keys: list[str]
    terms: list[str]
    min_hits: int = 1
    code: bool = False


@dataclass
class Plan:
    query: str
    terms: dict[str, float] = field(default_factory=dict)
    concepts: list[Concept] = field(default_factory=list)
    needles: list[str] = field(default_factory=list)
    matchers: list[str] = field(default_factory=list)

    def add(self, term: str, weight: float) -> None:
        if len(term) >= 2 and term not in W.EN_STOP:
            self.terms[term] = max(weight, self.terms.get(term, 0.0))


def segments(text: str) -> list[str]:
    return [x for run in _CJK.findall(text) for x in _BREAK.split(run) if len(x) >= 2]


def bigrams(x: str) -> list[str]:
    return [x[i : i + 2] for i in range(len(x) - 1)]


def lexical_tokens(query: str, synonyms: Mapping[str, list[str]] = W.SYNONYMS) -> list[str]:
    """Tokens of the title scorer: words, numbers, number-and-word forms and CJK bigrams, without stop words, with the synonyms that titles use."""
    low = query.lower()
    found = re.findall(r"[a-z][a-z0-9_.-]*|\d+[a-z][a-z0-9_.-]*|\d+", low)
    found += ["".join(m.groups()) for m in _GLUED.finditer(low)]
    stop = re.compile("|".join(map(re.escape, W.LEXICAL_CJK_STOP_WORDS)) + "|[" + W.CJK_STOP_CHARS + "]")
    for run in _CJK.findall(low):
        found += [g for x in stop.split(run) for g in (bigrams(x) if len(x) > 1 else [])]
    kept = [x for x in found if x not in W.LEXICAL_STOP]
    kept += [y for x in kept if x not in W.RETRIEVAL_ONLY for y in synonyms.get(x, ())]
    return list(dict.fromkeys(kept)) or list(dict.fromkeys(low.split()))


def analyse(query: str, synonyms: Mapping[str, list[str]] = W.SYNONYMS, aliases: Mapping[str, str] | None = None, without: frozenset[str] = frozenset()) -> Plan:
    """The plan as the query is written: literal terms, their synonyms, and manuals named by an alias of six letters or more."""
    plan = Plan(query)
    low = query.lower()
    words = list(dict.fromkeys([*_ASCII.findall(low), *("".join(m.groups()) for m in _GLUED.finditer(low))]))
    for word in words:
        word = word.rstrip(".-_") or word
        if len(word) < 2 or word in W.EN_STOP:
            continue
        plan.add(word, 1.0)
        terms = [word]
        if re.search(r"[_.-]", word):
            flat = re.sub(r"[-_.]", "", word)
            parts = [x for x in re.split(r"[-_.]+", word) if len(x) >= 2]
            for x in (flat, *parts):
                plan.add(x, 1.0)
            terms.append(flat)
        plan.concepts.append(Concept([word], terms, code=bool(re.search(r"[\d_]", word)) and len(word) >= 4))
    for x in segments(low):
        grams = bigrams(x)
        if len(x) <= 2:
            plan.add(x, 1.0)
        else:
            if len(x) <= 8:
                plan.add(x, 1.0)
            for g in grams:
                plan.add(g, BIGRAMS / len(grams))
        if x not in W.CJK_FILLER:
            plan.concepts.append(Concept([x], list(dict.fromkeys([*([x] if len(x) <= 8 else []), *grams])), 2 if len(grams) > 4 else 1))
    if "synonym" not in without:
        for concept in plan.concepts:
            for key in concept.keys:
                for extra in synonyms.get(key, ()):
                    for term in [*_ASCII.findall(extra.lower()), *segments(extra)]:
                        plan.add(term, SYNONYM)
                        concept.terms.append(term)
    for alias, term in (aliases or {}).items():
        if len(alias) >= 6 and alias in low:
            plan.add(term, 1.0)
    if "phrase" not in without:
        quoted = [x for pair in re.findall(r"\"([^\"]{6,})\"|“([^”]{6,})”|`([^`]{6,})`", query) for x in pair if x]
        if ERRORISH.search(query):
            quoted += [m.group().strip() for m in re.finditer(r"[A-Za-z0-9_'-]+(?: [A-Za-z0-9_'-]+){2,}", query) if len(m.group()) >= 12]
        plan.needles = list(dict.fromkeys(quoted))[:4]
    plan.matchers = lexical_tokens(query, {} if "synonym" in without else synonyms)
    return plan


def edits(term: str) -> set[str]:
    """Strings one edit away: a letter left out, added or changed, or two neighbours swapped."""
    letters = string.ascii_lowercase + string.digits
    halves = [(term[:i], term[i:]) for i in range(len(term) + 1)]
    out = {a + b[1:] for a, b in halves if b} | {a + b[1] + b[0] + b[2:] for a, b in halves if len(b) > 1}
    out |= {a + c + b[1:] for a, b in halves if b for c in letters} | {a + c + b for a, b in halves for c in letters}
    return out - {term}


def unseen(plan: Plan, df: Mapping[str, int]) -> list[str]:
    return [k for c in plan.concepts for k in c.keys if not df.get(k)]


def candidates(plan: Plan, df: Mapping[str, int]) -> set[str]:
    """Strings whose frequency the adaption of this plan asks for."""
    out: set[str] = set()
    for x in unseen(plan, df):
        if _CJK.fullmatch(x):
            out |= {x[i:j] for i in range(len(x)) for j in range(i + 2, min(len(x), i + 8) + 1)}
        elif re.fullmatch(r"[a-z0-9]{4,12}", x):
            out |= edits(x) | {x[:-k] for k in (1, 2, 3) if len(x) - k >= 4}
        elif re.search(r"[_.]", x) and len(x) >= 8:
            out |= {x[:-k] for k in range(1, 5)}
    for word in re.findall(r"[A-Za-z]+", plan.query):
        out |= {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", word) if len(p) >= 2}
    return out


def adapt(plan: Plan, df: Mapping[str, int], n_docs: int, prefixes: Mapping[str, list[str]] | None = None, synonyms: Mapping[str, list[str]] = W.SYNONYMS, without: frozenset[str] = frozenset(), aliases: Mapping[str, str] | None = None) -> Plan:
    """The plan with variants for what the corpus lacks, in this order: segments, identifiers, typing errors, prefixes, carried synonyms."""
    for concept in plan.concepts:
        for key in list(concept.keys):
            if df.get(key):
                continue
            if _CJK.fullmatch(key):
                if "segment" not in without and len(key) > 2:
                    for part in _resegmented(key, df, n_docs):
                        plan.add(part, min(0.75, max(0.5, len(part) / len(key))) if len(part) >= 5 else 0.1)
                        concept.terms.append(part)
                continue
            if "identifier" not in without and re.search(r"[_.]", key) and len(key) >= 8:
                stem = next((key[:-k] for k in range(1, 5) if 0 < df.get(key[:-k], 0) <= 0.05 * n_docs), None)
                if stem:
                    plan.add(stem, STEM)
                    concept.terms.append(stem)
            if "typo" not in without:
                for better, weight in _corrections(key, df, synonyms):
                    plan.add(better, weight)
                    concept.terms.append(better)
            if "typo" not in without:
                for manual in named_by_edit(key, aliases or {}):
                    plan.add(manual, ALIAS_EDIT)
                    concept.terms.append(manual)
            if "prefix" not in without and re.fullmatch(r"[a-z][a-z0-9]{3,7}", key):
                longer = [x for x in (prefixes or {}).get(key, ()) if re.match(r"v?\d", x[len(key) :])][:12]
                for x in longer:
                    plan.add(x, PREFIX)
                concept.terms += longer
            if "synonym" not in without and (concept.code or "_" in key):
                for extra in synonyms.get(key, ()):
                    if df.get(extra.lower()):
                        plan.add(extra.lower(), CARRIED)
    if "identifier" not in without:
        for word in re.findall(r"[A-Za-z]+", plan.query):
            parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", word)]
            if len(parts) > 1:
                for p in parts:
                    if df.get(p) or not df.get(word.lower()):
                        plan.add(p, CAMEL)
    return plan


def named_by_edit(x: str, aliases: Mapping[str, str]) -> list[str]:
    """Manuals with an alias of six letters or more that is one edit away from a word."""
    if not re.fullmatch(r"[a-z0-9]{4,12}", x):
        return []
    near = edits(x)
    return list(dict.fromkeys(m for alias, m in aliases.items() if len(alias) >= 6 and alias in near))


def looks_like_content(term: str) -> bool:
    if _CJK.fullmatch(term):
        return len(term) >= 2 and term not in W.CJK_FILLER
    return len(term) >= 3 and term not in W.GENERIC_WORDS and term not in W.EN_STOP and term not in W.FRAGMENT_SKIP


def _resegmented(x: str, df: Mapping[str, int], n_docs: int) -> list[str]:
    """Words of the corpus along an unknown CJK run: the longest from the left, a start one or two later if two longer."""
    rare = lambda w: 0 < df.get(w, 0) and (n_docs < 200 or df[w] < W.COMMON_DF * n_docs)
    longest = lambda i: next((n for n in range(min(8, len(x) - i), 1, -1) if rare(x[i : i + n])), 0)
    out, i = [], 0
    while i < len(x) - 1:
        n = longest(i)
        ahead = next((j for j in (i + 1, i + 2) if longest(j) >= n + 2), None) if n else None
        if ahead is not None:
            i = ahead
            continue
        if n:
            out.append(x[i : i + n])
        i += max(n, 1)
    return out


def _corrections(x: str, df: Mapping[str, int], synonyms: Mapping[str, list[str]]) -> list[tuple[str, float]]:
    """Words of the corpus for one it lacks: without its last letters, and one edit away if that is clearly the most frequent.

    Ordinary and generic words and fragments of names are no correction, nor is a word that holds the other. The first
    letter stays the same unless the correction has synonyms; letters are put in or left out only if either has; and so is
    a letter changed in a word of less than five.
    """
    if not re.fullmatch(r"[a-z0-9]{4,}", x):
        return []
    out = []
    if len(x) >= 5 and (cut := next((x[:-k] for k in (1, 2, 3) if len(x) - k >= 4 and df.get(x[:-k]) and x[:-k] not in W.FRAGMENT_SKIP), None)):
        out.append((cut, TAIL))
    near = []
    for y in edits(x) if len(x) <= 12 else ():
        if not df.get(y) or len(y) < 4 or y in x or x in y or y in NO_CORRECTION:
            continue
        swap = len(y) == len(x) and sorted(y) == sorted(x)
        if (y[0] == x[0] or y in synonyms) and (len(y) == len(x) or y in synonyms or x in synonyms):
            near.append((df[y], y, swap))
    near.sort(key=lambda p: (-p[0], p[1]))
    if near and (len(near) == 1 or near[0][0] >= 3 * near[1][0]):
        _, best, swap = near[0]
        if len(x) >= 5 or swap or best in synonyms:
            out.append((best, EDIT))
    return out


#: Words that a typing error is not corrected to.
NO_CORRECTION = frozenset([*W.FRAGMENT_SKIP, *W.EN_STOP, *W.GENERIC_WORDS, *W.LEXICAL_STOP])


def abstains(plan: Plan, df: Mapping[str, int], n_docs: int) -> bool:
    """Whether the corpus does not cover the query: what tells it apart is missing.

    A code-like word that no document has counts unless another concept of the corpus is there; otherwise some concept
    is missing and none that is there is rarer than common words. ``df`` is that outside answers.
    """
    if not plan.concepts:
        return True
    present = [sum(df.get(t, 0) > 0 for t in set(c.terms)) >= min(c.min_hits, len(set(c.terms))) for c in plan.concepts]
    topical = [ok and any(0 < df.get(t, 0) < max(1.5, W.COMMON_DF * n_docs) for t in c.terms) and not all(k in W.GENERIC_WORDS for k in c.keys) for c, ok in zip(plan.concepts, present)]
    if all(present):
        return False
    missing_code = any(c.code and not ok for c, ok in zip(plan.concepts, present))
    return not any(topical) or (missing_code and sum(topical) < 2)


def distinct_alternates(query: str, others: Iterable[str], most: int = 3, longest: int = 300) -> tuple[list[str], list[str]]:
    """Up to ``most`` other wordings, trimmed and different from the query and each other, and warnings on those left out."""
    kept, warnings = [], []
    seen = {query.strip().lower()}
    for x in others:
        x = x.strip()
        if not x or x.lower() in seen:
            continue
        if len(x) > longest:
            warnings.append(f"an alternate query of {len(x)} characters was left out; the limit is {longest}")
        elif len(kept) < most:
            kept.append(x)
            seen.add(x.lower())
        else:
            warnings.append(f"only {most} alternate queries are used")
            break
    return kept, warnings
