"""Names of people and organisations as sets of folded tokens, and their comparison."""

from __future__ import annotations

import functools
import math
import re
import unicodedata

from rollcall.functions.text import TITLES as FIXED_TITLES
from rollcall.llm.skeleton import consistent_form

# Titles in front of names, without accents and points: the fixed ones but 'ba' (also a name) and some more. Those taken only with their accents.
TITLES = {t for t in FIXED_TITLES.split("|") if t.isalpha()} - {"ba"} | {"miss", "sir", "madam"}
ACCENTED_TITLES = {"ông", "bà", "chị", "cô", "chú", "bác", "thầy"}
# Short forms of given names, each with the full forms it may stand for.
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "andi": "andres", "andy": "andres andrew", "ben": "benjamin", "beni": "benjamin", "beny": "benjamin", "bety": "elizabeth", "beth": "elizabeth",
    "liz": "elizabeth", "lizie": "elizabeth", "becky": "rebeca", "bec": "rebeca", "beca": "rebeca", "bil": "wiliam", "bily": "wiliam", "wil": "wiliam", "bob": "robert", "rob": "robert", "boby": "robert", "chris": "christopher",
    "kit": "christopher", "dora": "dorothea theodora", "thea": "dorothea", "dot": "dorothea", "fran": "francois francis", "franz": "francois", "fred": "frederick", "fredie": "frederick", "jon": "jonathan", "jonty": "jonathan",
    "nathan": "jonathan", "josie": "josephine", "jo": "josephine", "jup": "jurgen", "kate": "katherine", "kathy": "katherine", "kat": "katherine", "magie": "margaret", "pegy": "margaret", "meg": "margaret",
    "mick": "michael", "mike": "michael", "nick": "nicholas", "nico": "nicholas", "pat": "patricia", "paty": "patricia", "tricia": "patricia", "sam": "samantha", "ted": "theodore", "theo": "theodore",
    "tedy": "theodore", "tori": "victoria", "vicky": "victoria", "vicki": "victoria", "zo": "zoe",
}
# The parts of a Vietnamese syllable without accents; repeated letters count once.
_ONSET = "(?:b|ch|c|d|gh|gi|g|h|kh|k|l|m|ngh|ng|nh|n|ph|p|qu|q|r|s|th|tr|t|v|x)?"
_RIME = (
    "(?:a(?:ch|c|i|m|ng|nh|n|o|p|t|u|y)?|e(?:ch|c|m|ng|nh|n|o|p|t|u)?|i(?:ch|m|nh|n|p|t|u|a|ec|em|eng|en|ep|et|eu)?|o(?:c|i|m|ng|n|p|t|a|ac|ach|ai|am|an|ang|anh|ao|at|ay|e|en|eo|et)?"
    "|u(?:c|i|m|ng|n|p|t|a|u|y|ya|ych|yen|yet|yeu|ynh|yn|yt|oc|oi|om|ong|on|op|ot|ou|e|eh|en|enh|ech|ay|at|an|ang|anh|an)?|y(?:em|en|et|eu|eng|t|nh|n)?)"
)
SYLLABLE = re.compile(_ONSET + _RIME)
_FOLD = str.maketrans({"đ": "d", "ø": "o", "ł": "l", "ß": "s", "æ": "a", "œ": "o", "ð": "d", "þ": "t", "ı": "i", "ς": "σ"})
# Words that tell an organisation's type, longest first, without accents.
ORGANISATION_TYPES = (
    ("jsc", "cong ty co phan|cong ty cp|cty co phan|cty cp|c ty co phan|c ty cp|ctcp|joint stock company|joint stock co|j s c|jsc"),
    ("ltd", "cong ty trach nhiem huu han|cong ty tnhh|cty trach nhiem huu han|cty tnhh|c ty tnhh|tnhh|company limited|co ltd|company ltd|limited|ltd"),
    ("group", "tap doan|group corporation|group corp|grp corp|group|grp|td"),
    ("university", "truong dai hoc|truong dh|dai hoc|university|univ|dh"),
    ("hospital", "benh vien da khoa|benh vien|bv da khoa|bvdk|bv|general hospital|general hosp|hospital|hosp"),
    ("institute", "vien nghien cuu|vien nc|v nghien cuu|v nc|institute for research|research institute|res inst|institute|inst|vien"),
    ("centre", "trung tam|t tam|tt|center|centre|ctr"),
    ("association", "hiep hoi|association|assoc|assn|hoi|hh"),
    ("company", "cong ty|cty|c ty|company|corporation|corp|co"),
)
_TYPES = [(t, re.compile(f"(?:^| )(?:{w})(?= |$)")) for t, w in ORGANISATION_TYPES]
_BRANCH = re.compile(r"\s*[,;(–-]\s*(?:chi nhanh|cn|van phong|branch|office|northern|southern|eastern|western|central)\b.*$|\s+chi nhanh\b.*$")


_LETTERS = _FOLD | {code: base for code in range(0xC0, 0x1F00) if len(base := "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")) == 1 and base != chr(code)}


def fold(text: str) -> str:
    """Lower case base letters of the consistent form; characters of other scripts keep their letters."""
    text = consistent_form(text).lower().translate(_LETTERS)
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").translate(_FOLD)


@functools.lru_cache(1 << 16)
def _folded(word: str) -> str:
    return fold(word)


@functools.lru_cache(1 << 16)
def _spelt(token: str) -> str:
    """A token with letters typed twice once, and accents typed as letters removed where that leaves a syllable."""
    token = re.sub(r"(.)\1+", r"\1", token)
    if token.isascii() and len(token) > 2 and not SYLLABLE.fullmatch(token):
        bare = re.sub(r"w", "", token) if re.search(r"[aou]w", token) else token
        bare = re.sub(r"(?<=[aeiouywmnpctghdu])[sfrxj]$", "", bare)
        bare = re.sub(r"[sfrxj](?=(?:ch|nh|ng|c|m|n|p|t)?$)", "", bare) if not SYLLABLE.fullmatch(bare) else bare
        bare = re.sub(r"(.)\1+", r"\1", bare)
        if SYLLABLE.fullmatch(bare) and len(bare) > 1:
            return bare
    return token


_NOT_WORD, _SEPARATORS, _BYNAME = re.compile(r"[^\w]"), re.compile(r"[\s.,;_\-/+·|]+"), re.compile(r"[(\[{\"“][^)\]}\"”]*[)\]}\"”]?")


@functools.lru_cache(1 << 15)
def name_tokens(name: str | None) -> tuple[str, ...]:
    """Folded tokens of a person's name without titles, bracketed by-names and points; single letters are initials. () if there is no name."""
    if not name or "@" in name:
        return ()
    shown = consistent_form(name)
    shown = _BYNAME.sub(" ", shown)
    given_first = "," in shown
    if given_first:  # 'Ferrantis, Theodore F.' and 'Hung, Tran Khanh': what stands before the comma comes last
        head, _, tail = shown.partition(",")
        shown = f"{tail} {head}" if tail.strip() else head
    words = [w for w in _SEPARATORS.split(shown) if w]
    while len(words) > 1 and (_folded(words[0]) in TITLES or unicodedata.normalize("NFC", words[0].lower()) in ACCENTED_TITLES or (_folded(words[0]) in ("ba", "anh", "chi", "co") and len(words) > 4 and not given_first)):
        words = words[1:]
    tokens = (_spelt(_NOT_WORD.sub("", _folded(w))) for w in words)
    return tuple(t for t in tokens if t and not t.isdigit())


@functools.lru_cache(1 << 17)
def organisation(text: str | None) -> tuple[str, str]:
    """(core, type) of an organisation's name; the type is '' if no word tells it, the core '' if there is no name."""
    if not text:
        return "", ""
    plain = _BRANCH.sub("", fold(text))
    plain = " ".join(re.sub(r"[^\w]+", " ", plain.replace("-", "").replace("'", "")).split())
    found, rest = "", plain
    for kind, pattern in _TYPES:
        if pattern.search(rest):
            shorter = pattern.sub(" ", rest).strip()
            if shorter or found:
                rest = shorter
            if not found:
                found = kind
    rest = re.sub(r"\b(?:corp|company|co|ltd|limited|research|for|of|the)\b", " ", rest) if found else rest
    return "".join(rest.split()) or plain.replace(" ", ""), found


def distance_one(a: str, b: str) -> bool:
    """Whether one letter inserted, deleted, replaced or swapped with the next turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


#: What a pair of names scores that differ in one letter between two valid syllables: too little without a shared contact.
CLOSE = 0.4
# Forms of address that may also be names, so a name may have one more in front.
MAYBE_TITLES = {"anh", "ba", "chi", "co"}
# Frequent family names, to tell names written with the given name first.
SURNAMES = {
    "bui", "cao", "chu", "dang", "dao", "dinh", "do", "doan", "duong", "ha", "ho", "hoang", "huynh", "kieu", "la", "lam", "le", "luong", "luu", "ly", "mai", "ngo", "nguyen", "pham", "phan", "phung", "quach", "ta", "thai", "to", "tran", "trieu", "trinh", "truong", "vo", "vu", "vuong",
}
#: A syllable this much rarer (in log weight) than one that differs in a letter is its typing error: it occurs less than a thirtieth as often.
RARER = 3.4


@functools.lru_cache(1 << 18)
def token_likeness(a: str, b: str) -> float:
    """1 equal, 0.9 a short form, 0.85 a typing error, 0.6 an initial, 0 else. Two valid syllables are never each other's typing errors."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.6 if a[0] == b[0] else 0.0
    if b in NICKNAMES.get(a, "").split() or a in NICKNAMES.get(b, "").split() or (set(NICKNAMES.get(a, "").split()) & set(NICKNAMES.get(b, "").split())):
        return 0.9
    if min(len(a), len(b)) >= 3 or (len(a) + len(b) >= 5):
        if not (SYLLABLE.fullmatch(a) and SYLLABLE.fullmatch(b)) and distance_one(a, b):
            return 0.85
        if min(len(a), len(b)) >= 4 and a != b and sorted(a) == sorted(b) and SYLLABLE.fullmatch(a) is None:
            return 0.8
    return 0.0


NONE, WEAK, STRONG = 0, 1, 2


def _hopeless(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether some token of the shorter name a surely has no counterpart in b: a cheap test before the matching."""
    rest = list(b)
    alone = []
    for t in a:
        if t in rest:
            rest.remove(t)
        else:
            alone.append(t)
    if len(alone) > 2 and sum(len(t) > 1 for t in alone) > 2 and not any(len(t) == 1 for t in b):
        return True
    for t in alone:
        if not any(token_likeness(t, u) for u in rest) and not (len(t) == 1 and any(u[0] == t for u in b)):
            # One token that differs in a letter or order only is left to the weights.
            return not (len(alone) == 1 and len(a) == len(b) and any(distance_one(t, u) or sorted(t) == sorted(u) for u in rest))
    return False


def compare_names(a: tuple[str, ...], b: tuple[str, ...], wa: tuple[float, ...] | None = None, wb: tuple[float, ...] | None = None) -> tuple[int, float]:
    """(class, score): soft weighted token likeness of two names.

    STRONG: the same tokens in any order, but for a typing error or a short form. WEAK: one is an abbreviation of the
    other (initials, or inner names left out). The score is the weighted mean likeness over the heavier side's matched
    share; rare tokens (large weights) count more.
    """
    if len(a) > len(b):
        a, b, wa, wb = b, a, wb, wa
    if not a or _hopeless(a, b):
        return NONE, 0.0
    wa, wb = wa or (1.0,) * len(a), wb or (1.0,) * len(b)
    free, pairs = set(range(len(b))), []
    options = sorted(((token_likeness(x, y), min(len(x), len(y)), -abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    done = set()
    for like, _, _, i, j in options:
        if like <= 0:
            break
        if i not in done and j in free:
            done.add(i)
            free.discard(j)
            pairs.append((like, i, j))
    if len(done) < len(a):
        if len(a) == len(b) > 2 and len(done) == len(a) - 1 and all(p[0] == 1.0 for p in pairs):
            (x,), (y,) = [t for i, t in enumerate(a) if i not in done], [b[j] for j in free]
            if min(len(x), len(y)) > 1 and (distance_one(x, y) or sorted(x) == sorted(y)):
                wx, wy = [w for i, w in enumerate(wa) if i not in done][0], [wb[j] for j in free][0]
                if abs(wx - wy) >= RARER:
                    return STRONG, 1 - 0.2 * (wx + wy) / (sum(wa) + sum(wb))
                return WEAK, CLOSE
        return NONE, 0.0
    whole = [p for p in pairs if len(a[p[1]]) > 1 and len(b[p[2]]) > 1]
    errors = sum(1 for p in whole if p[0] < 0.9)
    score = sum(like * (wa[i] + wb[j]) for like, i, j in pairs) / (sum(wa) + sum(wb))
    if not whole or errors > (1 if len(whole) < 4 else 2) or not any(p[0] >= 0.85 and len(a[p[1]]) > 1 for p in whole):
        return NONE, 0.0
    if len(a) == len(b) and len(whole) == len(a):
        if len(a) == 1:
            return WEAK, score
        sure = any(p[0] == 1.0 for p in pairs) or min(map(len, a + b)) >= 4
        return (STRONG, score) if sure else (NONE, 0.0)
    taken = {j for _, _, j in pairs}
    used = {b[j] for j in taken}
    first = b[1] if b[0] in MAYBE_TITLES and len(b) > 3 and 0 not in taken else b[0]
    ends = {first, b[-1]} <= used
    given_first = b[0] not in SURNAMES and b[1] in SURNAMES and {b[0], b[1]} <= used
    return (WEAK, score) if len(a) > 1 and (ends or given_first) else (NONE, 0.0)


def _placed_grams(tokens: tuple[str, ...]) -> dict[tuple[str, int], None]:
    """Order-free 2-grams of tokens, the second reduced to its initial so that abbreviated names meet full ones; long tokens also alone. Each with the place of its first token."""
    grams = {}
    for i, t in enumerate(tokens):
        if len(t) > 1:
            forms = (t, *NICKNAMES[t].split()) if t in NICKNAMES else (t,)
            for j, u in enumerate(tokens):
                if i != j:
                    firsts = (u[0], *(x[0] for x in NICKNAMES[u].split())) if u in NICKNAMES else (u[0],)
                    for form in forms:
                        for first in firsts:
                            grams[f"{form}\x1f{first}", i] = None
            if len(t) >= 7 and not SYLLABLE.fullmatch(t):
                grams[t, i] = None
    return grams


@functools.lru_cache(1 << 16)
def _forms(token: str) -> tuple[tuple[str, ...], tuple[str, ...], bool]:
    """A token's forms, each ending as the first half of a gram; the initials of all; whether it is a gram alone."""
    forms = (token, *NICKNAMES.get(token, "").split())
    return tuple(f + "\x1f" for f in forms), tuple(f[0] for f in forms), len(token) >= 7 and not SYLLABLE.fullmatch(token)


def name_grams(tokens: tuple[str, ...]) -> list[str]:
    """The grams of _placed_grams() without places."""
    known, grams = [_forms(t) for t in tokens], {}
    for i, t in enumerate(tokens):
        if len(t) > 1:
            forms, _, alone = known[i]
            for j, (_, firsts, _) in enumerate(known):
                if i != j:
                    for form in forms:
                        for first in firsts:
                            grams[form + first] = None
            if alone:
                grams[t] = None
    return list(grams)


@functools.lru_cache(1 << 16)
def _gram_set(tokens: tuple[str, ...]) -> frozenset[str]:
    return frozenset(name_grams(tokens))


def overlap(a: tuple[str, ...], b: tuple[str, ...], share: float) -> bool:
    """Whether two names have at least the given share of the smaller one's grams in common."""
    x, y = _gram_set(a), _gram_set(b)
    return len(x & y) >= max(1, math.ceil(share * min(len(x), len(y))))


@functools.lru_cache(1 << 16)
def variants(token: str) -> tuple[str, ...]:
    """What two tokens that are alike (other than as an initial) have one of in common: themselves, themselves without a letter, their letters in order, the full forms."""
    out = {token, *NICKNAMES.get(token, "").split(), *(token[:i] + token[i + 1 :] for i in range(len(token)))}
    return tuple(sorted(out | {"~" + "".join(sorted(token))}))


def _placed_variants(tokens: tuple[str, ...]) -> dict[tuple[str, int], None]:
    return {(v, i): None for i, t in enumerate(tokens) if len(t) > 1 for v in variants(t)}


def contact_grams(tokens: tuple[str, ...]) -> list[str]:
    """Alike names have one of these in common."""
    return list(dict.fromkeys(g for g, _ in _placed_variants(tokens)))


def _finer(tokens: tuple[str, ...], grams: dict[tuple[str, int], None]) -> list[tuple[str, str, int]]:
    """(gram, part, role): what else names that share a gram and are alike have in common: a variant of another token (role 0), or an initial (role 1) where the other has a token that begins with it (role 2)."""
    out = {}
    for g, i in grams:
        if len(tokens) == 1:
            out[g, "", 0] = None
        for k, t in enumerate(tokens):
            if k == i:
                continue
            if len(t) == 1:
                out[g, t, 1] = None
            else:
                for v in variants(t):
                    out[g, v, 0] = None
                for first in {t[0], *(x[0] for x in NICKNAMES.get(t, "").split())}:
                    out[g, first, 2] = None
    return list(out)


def finer_name_grams(tokens: tuple[str, ...]) -> list[tuple[str, str, int]]:
    return _finer(tokens, _placed_grams(tokens))


def finer_contact_grams(tokens: tuple[str, ...]) -> list[tuple[str, str, int]]:
    return _finer(tokens, _placed_variants(tokens))
