"""One form for texts that look the same: look-alike classes by union-find, rewritten by an automaton."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.session import cut

# Characters of other scripts with the shape of a Latin letter, as (Latin, the others): Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu, phonetic.
SAME_SHAPE = (
    ("A", "ΑАᎪꓮ"), ("B", "ΒВᏴⲂꓐ"), ("C", "СϹᏟⲤꓚ"), ("D", "Ꭰꓓ"), ("E", "ΕЕᎬꓰ"), ("F", "Ϝꓝ"), ("G", "ԌᏀꓖ"), ("H", "ΗНᎻⲎꓧ"), ("I", "ΙІӀⲒꓲ"), ("J", "ЈͿᎫꓙ"), ("K", "ΚКᏦⲔꓗ"),
    ("L", "ԼᏞꓡ"), ("M", "ΜМᎷⲘꓟ"), ("N", "ΝⲚꓠ"), ("O", "ΟОՕⲞꓳ"), ("P", "ΡРᏢⲢꓑ"), ("Q", "Ԛ"), ("R", "Ꭱꓣ"), ("S", "ЅՏᏚꓢ"), ("T", "ΤТᎢⲦꓔ"), ("U", "Սꓴ"), ("V", "ѴᏙꓦ"), ("W", "ԜᎳᏔꓪ"),
    ("X", "ΧХⲬꓫ"), ("Y", "ΥУҮⲨꓬ"), ("Z", "ΖᏃꓜ"),
    ("a", "а"), ("c", "сϲⲥᴄ"), ("d", "ԁ"), ("e", "е"), ("g", "ց"), ("h", "һհ"), ("i", "іᎥ"), ("j", "јϳյ"), ("l", "ӏ"), ("n", "ո"), ("o", "оοօⲟᴏ"), ("p", "рⲣ"), ("q", "ԛզ"), ("s", "ѕꜱ"),
    ("u", "υս"), ("v", "νѵᴠ"), ("w", "ԝᴡ"), ("x", "х"), ("y", "у"), ("z", "ᴢ"), ("Æ", "Ӕ"), ("æ", "ӕ"), ("Ə", "Ә"), ("ə", "ә"),
    # punctuation and blanks; dashes, the fraction and the division slash are kept apart
    ("-", "‐‑"), (";", ";"), ("·", "·ꞏ⸱"), ("!", "ǃ"), ("|", "ǀ∣"), (":", "։׃꞉∶"), (",", "‚"), ("’", "ʼ՚"), ("′", "ʹ"), (" ", "\u3164\uffa0\u2800"),
)
# Strings of several characters with the look of another string, besides those that follow by rule from the character database.
SAME_STRINGS = (("||", "ǁ"), ("Оу", "Ѹ"), ("оу", "ѹ"), ("וו", "װ"), ("וי", "ױ"), ("יי", "ײ"))
# Characters without width or ink, besides the joiners and variation selectors.
INVISIBLE = "\u00ad\u034f\u061c\u17b4\u17b5\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: Joiners are invisible too, but between emoji or in scripts that join letters they change what is seen.
JOINERS = "\u200c\u200d"
#: Variation selectors change nothing after letters of these kinds of names, but may after others (ideographs, symbols, emoji).
SELECTORS = "".join(map(chr, range(0xFE00, 0xFE10)))
PLAIN_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "CHEROKEE", "COPTIC", "LISU", "GEORGIAN")
# Letters that look like a letter of another name in one of their cases only; where case is ignored they would join two Latin letters.
CASELESS = "Ӏνυ"
# Letter variants that the database calls compatible but a reader tells apart.
VARIANTS = "ſϐϑϒϓϔϕϖϰϱϲϴϵϹ"
#: Kinds of compatibility decomposition that leave the look as it is.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")


#: Characters of a piece whose form is remembered, and how many are: a few MB in a worker.
PIECE, PIECES = 32, 1 << 16


class Classes:
    """Union-find over strings of one or more code points; transitive by construction."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.up.get(root, root) != root:
            root = self.up[root]
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.up):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def pairs(fold_case: bool = False) -> Iterator[tuple[str, str]]:
    """Strings that look the same, by rule from the character database and from the fixed values."""
    for latin, others in SAME_SHAPE:
        for o in others:
            if not (fold_case and o in CASELESS and o.islower()):
                yield latin, o
    yield from SAME_STRINGS
    for cp in range(0x80, 0x110000):
        c = chr(cp)
        kind, _, _ = unicodedata.decomposition(c).partition(" ")
        if kind in SAME_LOOK:
            flat = unicodedata.normalize("NFKD", c)
            if kind != "<compat>" or _alike(c, flat):
                yield c, flat
    if fold_case:  # for comparisons that ignore case: a letter and its other case
        for latin, others in SAME_SHAPE:
            for c in latin + others:
                if c.lower() != c and c not in CASELESS:
                    yield c, c.lower()


def _alike(c: str, flat: str) -> bool:
    """Of the unspecific decompositions: letters and ligatures, blanks and dots, but no marks on a blank and no bracketed or dotted numbers."""
    cat = unicodedata.category(c)
    if c in VARIANTS:
        return False
    if cat == "Zs":
        return flat == " "
    if cat[0] == "L" or cat == "Nl":
        return all(unicodedata.category(x)[0] in "LM" for x in flat)
    return set(flat) <= set(".!?")  # leaders and double marks


@lru_cache(4)
def look_classes(fold_case: bool = False) -> tuple[tuple[str, ...], ...]:
    """The classes of more than one member."""
    uf = Classes()
    for a, b in pairs(fold_case):
        uf.join(a, b)
    return tuple(tuple(c) for c in uf.classes() if len(c) > 1)


class Rewriter:
    """Rewrites a text to the representatives of its classes, longest pattern first at every place.

    The representative of a class is its most frequent member by `counts`, ties and the unknown to
    the least ASCII member, else the least; a class with strings of several characters has its most
    frequent string, written in the representatives of its characters. Canonically equivalent spellings are one: the
    text is decomposed, rewritten and composed again. `fold_case` also ignores case.
    """

    def __init__(self, counts: Mapping[str, int] | None = None, fold_case: bool = False):
        counts = counts or {}
        self.fold_case = fold_case
        self.to: dict[str, str] = dict.fromkeys(INVISIBLE, "")
        order = lambda m: (-counts.get(m, 0), not m.isascii(), m != m.casefold() if fold_case else False, m)
        strings = []
        for members in look_classes(fold_case):
            if any(len(m) > 1 for m in members):
                strings.append(members)
                continue
            best = min(members, key=order)
            self.to |= {m: best for m in members if m != best}
        for members in strings:  # one sign for several is written out, in representatives
            best = "".join(self.to.get(c, c) for c in min((m for m in members if len(m) > 1), key=order))
            self.to |= {m: best for m in members if m != best}
        #: Whether texts of ASCII characters only are in their one form already.
        self.plain_ascii = not any(m.isascii() and not (fold_case and m != m.casefold()) for m in self.to)
        #: What blanks between pieces become; None if a string of several characters holds one, and texts are no pieces then.
        self.blank = None if any(" " in m and len(m) > 1 for m in self.to) else self.to.get(" ", " ")
        self._machine, self._pieces = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None, "_pieces": {}}

    def machine(self) -> ahocorasick.Automaton:
        """The automaton of all members that are rewritten; made once per process, some thousand patterns."""
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for m, best in self.to.items():
                self._machine.add_word(m, (len(m), best))
            self._machine.make_automaton()
        return self._machine

    def __call__(self, text: str) -> str:
        if text.isascii() and self.plain_ascii:
            return text.casefold() if self.fold_case else text
        if self.blank is None:
            return self._rewritten(text)
        # nothing is composed or rewritten across a blank, and pieces between blanks recur
        known, out = self._pieces, []
        for piece in text.split(" "):
            new = known.get(piece)
            if new is None:
                new = self._rewritten(piece)
                if len(piece) <= PIECE and len(known) < PIECES:
                    known[piece] = new
            out.append(new)
        return self.blank.join(out)

    def _rewritten(self, text: str) -> str:
        if self.fold_case:
            text = text.casefold()
        t = unicodedata.normalize("NFD", text)
        if any(c in t for c in JOINERS):
            t = _drop_joiners(t)
        if not t.isascii() and any(c in t for c in SELECTORS):
            t = _drop_selectors(t)
        out, at = [], 0
        for end, (size, best) in self.machine().iter_long(t):  # leftmost, longest, without overlap
            out.append(t[at : end + 1 - size])
            out.append(best)
            at = end + 1
        out.append(t[at:])
        return unicodedata.normalize("NFC", "".join(out))


def _drop_selectors(t: str) -> str:
    """Without variation selectors after letters, marks and blanks whose look they don't change, and at the start."""
    out: list[str] = []
    for c in t:
        if c in SELECTORS:
            before = out[-1] if out else ""
            if not before or before.isspace() or unicodedata.category(before)[0] == "M" or (before.isalpha() and unicodedata.name(before, "").startswith(PLAIN_SCRIPTS)):
                continue
        out.append(c)
    return "".join(out)


def _drop_joiners(t: str) -> str:
    """Without joiners, but for those between emoji and after letters of scripts that join."""
    out: list[str] = []
    for i, c in enumerate(t):
        if c in JOINERS:
            before = next((x for x in reversed(out) if x not in INVISIBLE), "")
            after = next((x for x in t[i + 1 : i + 9] if x not in JOINERS and x not in INVISIBLE), "")
            emoji = c == "‍" and before and after and (unicodedata.category(before) in ("So", "Sk") or before == "️") and unicodedata.category(after) == "So"
            joining = before and after and all("؀" <= x <= "ࣿ" or "ऀ" <= x <= "෿" for x in (before, after))
            if not (emoji or joining) or before in JOINERS:
                continue
        out.append(c)
    return "".join(out)


@lru_cache(2)
def _members() -> tuple[tuple[int, ...], tuple[str, ...]]:
    members = [m for c in look_classes() for m in c]
    return tuple(ord(m) for m in members if len(m) == 1), tuple(m for m in members if len(m) > 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    singles, several = _members()
    known = np.zeros(0x110000, bool)
    known[list(singles)] = True
    total = np.zeros(0x110000, np.int64)
    strings = dict.fromkeys(several, 0)
    for batch in batches:
        texts = [unicodedata.normalize("NFD", t) for t in batch.column(0).to_pylist() if t]
        for i in range(0, len(texts), 512):
            joined = "\n".join(texts[i : i + 512])
            cps, n = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            total[cps] += n
            for s in strings:
                if s[0] in joined:
                    strings[s] += joined.count(s)
    at = np.flatnonzero((total > 0) & known)
    found = [(chr(i), int(total[i])) for i in at] + [(s, n) for s, n in strings.items() if n]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["member", "n"])


def member_counts(df: DataFrame, text: str) -> DataFrame:
    """Columns (member, n): how often each member of a look-alike class occurs in all texts. Counted per partition first."""
    return df.select(F.col(text)).mapInArrow(_count, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))


def rewriter_of(df: DataFrame, text: str) -> Rewriter:
    """The rewriter with the representatives most frequent in `df`. Class members are a fixed set of some thousand strings, so their counts fit the driver."""
    return Rewriter({r.member: r.n for r in member_counts(df, text).collect()})


def same_look(sc, rewriter: Rewriter):
    """A column function: the one form of a text; NULL stays NULL."""
    shared = sc.broadcast(rewriter)

    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        r = shared.value
        return pa.array([None if t is None else r(t) for t in texts.to_pylist()], pa.string())

    return form


def look_forms(documents: DataFrame, rewriter: Rewriter | None = None) -> DataFrame:
    """Columns (doc_id, form): every document's text in its one form. Texts are equal there exactly if they look the same."""
    r = rewriter or rewriter_of(documents, "text")
    return documents.select("doc_id", same_look(documents.sparkSession.sparkContext, r)(F.col("text")).alias("form"))


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c.cast("binary")))


def look_classes_of(documents: DataFrame, rewriter: Rewriter | None = None) -> DataFrame:
    """Columns (doc_id, look, raw): digests of the form and of the text itself, one row per document; NULL texts have none."""
    r = rewriter or rewriter_of(documents, "text")
    form = same_look(documents.sparkSession.sparkContext, r)
    return documents.where("text is not null and doc_id is not null").select("doc_id", _digest(form(F.col("text"))).alias("look"), _digest(F.col("text")).alias("raw")).distinct()


def look_groups(rows: DataFrame) -> DataFrame:
    """Columns (look, spellings, documents) over rows of look_classes_of; counted by spelling first, so no look or spelling needs one task."""
    spelled = rows.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"))
    return spelled.groupBy("look").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("documents"))


def look_members(documents: DataFrame, rewriter: Rewriter | None = None) -> DataFrame:
    """Columns (doc_id, look, raw, spellings, documents): every document with its class, and how many spellings and documents the class has.

    Digests are joined, no texts and no pairs of documents. NULL texts are in no class.
    """
    rows = cut(look_classes_of(documents, rewriter))
    return rows.join(look_groups(rows), "look")


def look_pairs(documents: DataFrame, rewriter: Rewriter | None = None) -> DataFrame:
    """Columns (doc_id_a, doc_id_b), a < b: texts that are not identical but look the same.

    Documents whose class has one spelling only, however many copies there are, leave first. Pairs
    of spellings are expanded to documents, since pairs are what is asked, so the work follows the
    result; look_members has the same classes without pairs.
    """
    rows = cut(look_classes_of(documents, rewriter))
    some = cut(rows.join(look_groups(rows).where("spellings > 1").select("look"), "look", "left_semi"))
    spelled = some.select("look", "raw").distinct()
    pairs = spelled.select("look", F.col("raw").alias("ra")).join(spelled.select("look", F.col("raw").alias("rb")), "look").where("ra < rb").select("ra", "rb")
    a, b = some.select(F.col("raw").alias("ra"), F.col("doc_id").alias("x")), some.select(F.col("raw").alias("rb"), F.col("doc_id").alias("y"))
    found = pairs.join(a, "ra").join(b, "rb").where("x <> y")
    return found.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
