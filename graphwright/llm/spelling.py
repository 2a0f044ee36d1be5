"""Reading and comparing names that people typed (plain Python, used inside Arrow batches)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations, product

# Titles and letters after names.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame herr frau phd dphil msc mag mba md ba bsc dipl ing rer nat retd ret esq jr sr hon".split())
# Small words inside surnames.
PARTICLES = frozenset("van von vom zu zur der den ten ter de del della di da dos das du la le el al bin ibn af av y".split())
# Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sascha xander lex sandy alec", "anthony": "tony anton ant toni", "benjamin": "ben benny benji", "cornelius": "kees neil cor corny niels",
    "dorothea": "dora dot dorothy dory thea dotty dottie", "elizabeth": "liz beth betty eliza lisa lizzie betsy bess libby elsie elisabeth liza", "frederick": "fred freddy freddie fritz rick frederic", "gregory": "greg gregor",
    "gwendolyn": "gwen wendy gwenda", "johannes": "hannes jannes jan hans johann john", "josephine": "jo josie josy fina", "katherine": "kate kathy kat katie kitty kathryn kay", "leonard": "len lenny leo leon",
    "margaret": "maggie peggy greta meg marge margot madge rita daisy", "matthias": "matt hias matti mat matthew", "nikolaus": "niko klaus nick nico claus nikolas nicolaus", "penelope": "penny nell pen nelly", "rebecca": "becky becca beck reba",
    "richard": "rick dick rich ricky richie", "robert": "bob bobby rob robbie bert robby", "susannah": "sue sanna susan susie susanna zuzu suzy", "thandiwe": "thandi", "theodore": "ted theo teddy", "ursula": "uschi ulla ursel",
    "victoria": "vicky tori vic vicki tory", "wilhelmina": "mina willa minna helma billie wilma", "william": "bill will billy willy liam wil", "yusuf": "yus joe yusef", "emeka": "emy", "chiara": "kia", "eleni": "leni elena", "miguel": "migue mig",
    "oksana": "ksana oksa ksenia", "françois": "franz frank fran", "tomás": "tom tommy thomas thom", "jürgen": "juergen jurgen jorg", "håkon": "haakon", "søren": "soeren", "bjørn": "bjoern", "zoë": "zoe", "łucja": "lucja lucy", "inés": "ines",
    "kenji": "ken", "duarte": "edu", "amara": "mara", "noor": "nor", "priya": "pri", "ravi": "rav",
    "abigail": "abby gail", "amanda": "mandy", "anastasia": "nastya stasia", "andrew": "andy drew andreas andre", "angela": "angie", "barbara": "barb babs", "caroline": "carrie caro", "charles": "charlie chuck chas karl carl", "charlotte": "lottie",
    "christine": "chrissy tina christina", "christopher": "chris kit topher christoph", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dmitri": "dima mitya dimitri", "donald": "don donnie", "edward": "ed eddie ned eduard", "eleanor": "ellie nora",
    "emily": "emmy", "eugene": "gene", "francisco": "paco pancho", "gabriele": "gabi gaby", "geoffrey": "geoff jeff jeffrey", "gerald": "gerry jerry", "giovanni": "gianni", "giuseppe": "beppe", "heinrich": "heinz heiner", "helena": "lena", "henry": "harry hank hal", "ignacio": "nacho",
    "isabella": "bella izzy", "ivan": "vanya", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "jonathan": "jon jonny", "joseph": "joey josef sepp", "joshua": "josh", "judith": "judy", "kenneth": "kenny",
    "kimberly": "kim", "lawrence": "larry laurie", "louise": "lou", "luigi": "gigi", "madeleine": "maddie", "maria": "mitzi", "michael": "mike mick mikey micha michel mikhail misha", "nathaniel": "nate", "natalia": "natasha", "nicolai": "kolya", "pamela": "pam",
    "patricia": "pat patty patsy tricia trish", "peter": "pete", "philip": "phil phillip", "philippa": "pippa", "raymond": "ray", "ronald": "ron ronnie", "samuel": "sam sammy", "sarah": "sally sadie", "sebastian": "basti seb", "stephanie": "steph steffi",
    "stephen": "steve stevie steven stefan", "tatiana": "tanya", "teresa": "tess", "timothy": "tim timmy", "ulrich": "uli", "valerie": "val", "vincent": "vince vinny", "vladimir": "vova volodya", "walter": "walt wally", "wolfgang": "wolf", "zachary": "zach zack",
}
# Short forms of words in names of organisations.
ORG_SHORT = {
    "department": "dept dpt dep dpmt", "university": "univ uni u", "foundation": "fdn found fnd fndn foundn", "company": "co comp cmpy cy", "institute": "inst instit insti i", "laboratory": "lab labs labor l", "association": "assoc assn ass asso",
    "centre": "center ctr cent cntr centr", "agency": "agcy agy ag agen",
}
# Words that carry nothing, and legal forms.
ORG_STOP = frozenset("of for f the and at in a an und der die das de la el y fur für & o".split())
ORG_LEGAL = frozenset("as a.s. oyj aps sarl spa s.p.a. kk pty ltd limited inc incorporated gmbh ag sa s.a. plc llc corp bv ev e.v. kg srl oy ab nv".split())

_FOLD = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "’": "'", "`": "'"})
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Compatibility form in lower case without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_FOLD)


def unscan(word: str) -> str:
    """Undo what scanners do to letters: digits inside words, rn for m."""
    if any(c.isalpha() for c in word):
        word = word.replace("0", "o").replace("1", "l").replace("5", "s")
    return word.replace("rn", "m")


_NICK: dict[str, str] = {}
for _full, _short in NICKNAMES.items():
    for _n in [_full, *_short.split()]:
        _NICK.setdefault(unscan(fold(_n)), unscan(fold(_full)))
_SHORT = {s: k for k, v in ORG_SHORT.items() for s in v.split()}


@lru_cache(maxsize=200_000)
def _letters(word: str) -> int:
    """The letters of a word as bits; letters can share one."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, neighbouring swaps counting one; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # an edit brings or takes at most one letter
    x, y = _letters(a), _letters(b)
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return most + 1
    return _edits(a, b, most)


@lru_cache(maxsize=200_000)
def _edits(a: str, b: str, most: int) -> int:
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, two[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def alike(a: str, b: str) -> bool:
    """The same word but for typos: none in words below 4 letters, one below 7, two from 7 on."""
    n = min(len(a), len(b))
    allowed = 0 if n < 4 else 1 if n < 7 else 2
    return a == b or (allowed > 0 and distance(a, b, 2) <= allowed)


def _cleaned(text: str) -> tuple[list[str], list[str] | None]:
    """Words before and after a comma that puts a surname first, titles left out; None after none."""
    head, comma, tail = fold(text).partition(",")
    clean = lambda s: [unscan(w) for w in _WORDS.findall(s.replace("'", "")) if w not in TITLES]
    if comma and (rest := clean(tail)):
        return clean(head), rest
    return clean(head), None


def roles(text: str) -> tuple[list[str], list[str]]:
    """(words where given names stand, words where surnames stand) of a typed name, from its order alone; initials count for neither."""
    first, rest = _cleaned(text)
    head, tail = ([w for w in ws or [] if w not in PARTICLES and len(w) > 1] for ws in (first, rest))
    if rest is not None:
        return tail[:1], head
    return (head[:1], head[-1:]) if len(head) > 1 else ([], [])


#: How many times more frequent a name must be for one a typo away to be its misspelling.
COMMONER = 5


class Given:
    """Given names: the short forms in NICKNAMES and names that a corpus puts first, with how often it does.

    A name one typo from one that is COMMONER times as frequent is a misspelling of it.
    """

    def __init__(self, more: dict[str, int] | None = None) -> None:
        more = more or {}
        self.names = {w: w for w in more} | _NICK
        self.near: dict[str, set[str]] = {}
        for g in {*_NICK.values(), *(w for w in more if w not in _NICK)}:
            if len(g) >= 4:
                for d in _shortened(g, 1):
                    self.near.setdefault(d, set()).add(g)
        for w, n in more.items():
            if w not in _NICK and len(w) >= 3:
                hits = {g for d in _shortened(w, 1) for g in self.near.get(d, ()) if more.get(g, 0) >= COMMONER * n and distance(w, g, 1) == 1}
                if len(hits) == 1:
                    self.names[w] = _NICK.get(g := hits.pop(), g)
        self.known: dict[str, str | None] = {}

    def full(self, word: str) -> str | None:
        """The given name that a word is, in full form, one typo allowed if it leaves one name; None if it is none known."""
        if word not in self.known:
            out = self.names.get(word)
            if out is None and len(word) >= 4:
                hits = {self.names.get(g, g) for d in _shortened(word, 1) for g in self.near.get(d, ()) if distance(word, g, 1) == 1}
                out = hits.pop() if len(hits) == 1 else None
            self.known[word] = out
        return self.known[word]


@lru_cache(maxsize=1)
def _plain_given() -> Given:
    return Given()


def read_person(text: str, given_names: Given | None = None) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """(given names and initials, surname parts) of a typed name, each in full and in order; None if either is missing.

    A comma puts the surname first.  Without one, words that are no known
    given name are surname parts; if there is none, the last word is.
    """
    full = (given_names or _plain_given()).full
    first, rest = _cleaned(text)
    if rest is not None:
        surname = [w for w in first if w not in PARTICLES and len(w) > 1] or first
        given = [w if len(w) == 1 else full(w) or w for w in rest if w not in PARTICLES]
    else:
        words = [w for w in first if w not in PARTICLES]
        kinds = [(w, w if len(w) == 1 else full(w)) for w in words]
        surname = [w for w, g in kinds if g is None]
        given = [g for _, g in kinds if g is not None]
        if not surname and len(given) > 1:
            long = [k for k, (w, _) in enumerate(kinds) if len(w) > 1]
            if not long:
                return None
            surname = [words[long[-1]]]
            given = [g for k, (_, g) in enumerate(kinds) if k != long[-1] and g]
        elif surname and not given and len(surname) > 1:
            given, surname = surname[:1], surname[1:]
    return (tuple(given), tuple(surname)) if given and surname else None


def same_person_name(a: tuple[tuple[str, ...], tuple[str, ...]], b: tuple[tuple[str, ...], tuple[str, ...]]) -> int:
    """2 if both names can be one person's by full given names, 1 if only by an initial, 0 if not."""
    (ga, sa), (gb, sb) = a, b
    few, many = (sa, sb) if len(sa) <= len(sb) else (sb, sa)
    left = list(many)
    for s in few:
        hit = next((t for t in left if t == s), None) or next((t for t in left if alike(s, t)), None)
        if hit is None:
            return 0
        left.remove(hit)
    full_a, full_b = [g for g in ga if len(g) > 1], [g for g in gb if len(g) > 1]
    x, y = ga[0], gb[0]
    if len(x) == 1 or len(y) == 1:
        # an initial before a full name stands for it; one behind a full name says nothing
        return 1 if x[0] == y[0] else 0
    if not alike(x, y):
        return 0
    if len(full_a) > 1 and len(full_b) > 1 and not alike(full_a[1], full_b[1]):
        return 0
    return 2


def read_org(text: str) -> tuple[str, ...] | None:
    """Words of an organisation's name, short forms of kinds written out, without filling words and legal forms; None if none is left."""
    flat = fold(text)
    raw = re.findall(r"[^\W_]+(?:\.[^\W_](?![^\W_]))*\.?|&", flat)
    out = []
    for w in raw:
        dotted = w.endswith(".")
        w = w.rstrip(".")
        if w in ORG_LEGAL or w.replace(".", "") in ORG_LEGAL or w in ORG_STOP:
            continue
        w = w.replace(".", "")
        if w in _SHORT and (len(w) > 1 or dotted):
            w = _SHORT[w]
        w = unscan(w)
        out.append(w + "." if dotted and w not in ORG_SHORT else w)
    return tuple(sorted(out)) if out else None


def _word_fits(a: str, b: str) -> bool:
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y or alike(x, y):
        return True
    for s, full, dotted in ((x, y, a.endswith(".")), (y, x, b.endswith("."))):
        if dotted and len(s) < len(full) and len(s) >= 2:
            if full.startswith(s) or (len(s) >= 4 and distance(s, full[: len(s)], 1) <= 1):
                return True
    return False


def same_org_name(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """2 if two word lists name one organisation word by word, 1 if one has the other's initials for some words, 0 if neither."""
    left, extra = list(b), []
    # more words of ``a`` without a partner than this end as 0 whatever follows
    room = 0 if len(a) == len(b) else max(len(a) - len(b), 0) + 1
    for w in sorted(a, key=len, reverse=True):
        hit = w if w in left else next((t for t in left if _word_fits(w, t)), None)
        if hit is None:
            extra.append(w)
            if len(extra) > room:
                return 0
        else:
            left.remove(hit)
    if not extra and not left:
        return 2 if len(a) > 1 else 0
    # a single short word on one side only is a legal form or a filling word not in the lists
    if len(extra) + len(left) == 1 and len((extra or left)[0]) <= 3 and min(len(a), len(b)) >= 3:
        return 2
    for short, words, both in ((extra, left, a), (left, extra, b)):
        if len(short) == 1 and len(words) >= 2 and len(both) > 1 and 2 <= len(short[0]) <= 8:
            if sorted(short[0]) == sorted(w[0] for w in words) or sorted(short[0]) == sorted(["o", *(w[0] for w in words)]):
                return 1
    return 0


def deletions(word: str) -> list[str]:
    """The word and, from 5 letters on, the word less any one letter: words one edit apart share one of these."""
    return [word] if len(word) < 5 else sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})


def two_edit_keys(word: str) -> set[str]:
    """Parts of a word of 7 letters or more: two such words within two edits share one, edits across the borders of the parts aside.

    Either the first two letters or the last three are untouched, or one edit
    is in each and what lies between is whole.
    """
    if len(word) < 7:
        return set()
    return {f"{word[:2]}<", f">{word[-3:]}"} | {f"={word[i : len(word) - j]}" for i in (1, 2, 3) for j in (2, 3, 4) if len(word) - i - j > 0}


def _shortened(word: str, most: int) -> set[str]:
    """The word less up to ``most`` letters."""
    out = new = {word}
    for _ in range(most):
        new = {w[:i] + w[i + 1 :] for w in new for i in range(len(w))}
        out = out | new
    return out


class WordTokens:
    """What a word of an organisation's name can stand for: words that fit each other share a token.

    ``common`` has the common words and their counts.  The tokens of a word are
    the common words that it fits; where it is not common or is cut short, also
    its first two letters and its last three, which rank as rarer than all.
    """

    def __init__(self, common: dict[str, int]) -> None:
        self.common, self.known = common, {}
        self.typos: dict[str, set[str]] = {}
        self.heads: dict[str, set[str]] = {}
        for c in common:
            for x in _shortened(c, 0 if len(c) < 4 else 1 if len(c) < 7 else 2):
                self.typos.setdefault(x, set()).add(c)
            for n in range(2, len(c)):
                for x in _shortened(c[:n], 0 if n < 4 else 1):
                    self.heads.setdefault(x, set()).add(c)

    def of(self, word: str) -> tuple[tuple[int, str], ...]:
        """(count, token), rarest first."""
        if word not in self.known:
            x, dotted = word.rstrip("."), word.endswith(".")
            near = set().union(*(self.typos.get(d, ()) for d in _shortened(x, 0 if len(x) < 4 else 1 if len(x) < 7 else 2)))
            if dotted:
                near = near.union(*(self.heads.get(d, ()) for d in _shortened(x, 0 if len(x) < 4 else 1)))
            out = {(self.common[c], c) for c in near if _word_fits(word, c)}
            if dotted or x not in self.common:
                out |= {(0, f"<{x[:2]}"), (0, f">{x[-3:]}")}
            self.known[word] = tuple(sorted(out))
        return self.known[word]


def rarest_together(words: list[str], tokens: WordTokens, most: int = 3) -> set[str]:
    """The ``most`` rarest tokens of a name, for every reading of its words: names that agree word by word share one of these.

    Words of up to three letters can be left out, as ``same_org_name`` does.
    """
    if len(words) < 2:
        return set()
    options = [tokens.of(w) for w in words]
    # the latest that a word can stand in the order; one that can be left out, behind all
    last = [(float("inf"), "") if len(w) <= 3 and len(words) > 3 else o[-1] for w, o in zip(words, options, strict=True)]
    bound = sorted(last)[most] if len(last) > most else (float("inf"), "")
    few = [[t for t in o if t <= bound] for o in options]
    used = [i for i, o in enumerate(few) if o]
    out = set()
    for n in range(1, most + 1):
        for at in combinations(used, n):
            others = [last[i] for i in range(len(words)) if i not in at]
            least = min(others, default=(float("inf"), ""))
            if n < most and least[0] != float("inf"):
                continue
            out |= {"&".join(x for _, x in sorted(c)) for c in product(*(few[i] for i in at)) if max(c) <= least}
    return out


def acronym_keys(words: list[str], tokens: WordTokens) -> list[tuple[str, int]]:
    """(key, kind): a name with an acronym has a key of kind 1 that the name it stands for has with kind 2.

    A key is a token of a word that both names have, and the initials of all other words.
    """
    if len(words) < 2:
        return []
    out = []
    for i, w in enumerate(words):
        rest = [x[0] for j, x in enumerate(words) if j != i]
        if len(rest) > 1:
            out += [(f"@{''.join(sorted(rest))}|{t}", 2) for _, t in tokens.of(w)]
        for j, e in enumerate(words):
            if j != i and 2 <= len(e) <= 8 and not e.endswith("."):
                other = [x[0] for k, x in enumerate(words) if k not in (i, j)]
                for letters in {e, e.replace("o", "", 1)}:
                    out += [(f"@{''.join(sorted([*letters, *other]))}|{t}", 1) for _, t in tokens.of(w)]
    return out
