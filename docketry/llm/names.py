"""Problem 5: variant spellings of one person or organisation.

Every name is rewritten to its canonical forms by rules: titles, articles and
additions fall away, nicknames give the given names they stand for, initials
stay open, abbreviations give their full words, legal forms fall away, word
order doesn't matter and blanks inside the distinctive word close.  What is
left is a key: (distinctive word, line of business, kind) of an organisation,
(surname, given name) of a person.

Slips of the pen in the distinctive word are met by its deletion forms: the
word with up to two letters left out.  The forms are exploded and joined by
equality within one line of business (or given name).  A shared form is the
stronger evidence the rarer it is, which gives a link its score; an edit
distance of at most two (one for short words) confirms it.  Keys that
are linked so, or by standing in one row as raw and canonical name, are one
entity.  An open name (an initial in place of a given name) that fits several
entities by slips goes to the one whose best score leaves the others behind by
``MARGIN``, and to none where the scores don't tell them apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut
from docketry.llm.components import groups

#: Keys of one form that are compared in one group; more are spread over pairs of tiles.
TILE = 1000

#: The best entity of an open name scores so many times as high as the next.
MARGIN = 1.5

#: Kinds of company and their abbreviations.
KINDS = {
    "associates": "associates assoc assocs assc asscs associate", "group": "group grp grps", "holdings": "holdings hldg hldgs holding", "services": "services svc svcs serv servs service",
    "partners": "partners ptnrs", "enterprises": "enterprises ent entps", "industries": "industries inds", "solutions": "solutions solns", "systems": "systems sys",
}
#: Lines of business and their abbreviations.
BUSINESS = {
    "travel": "travel trvl", "auto": "auto", "solar": "solar", "ticket": "ticket tkt", "roofing": "roofing roof", "medical": "medical med", "dental": "dental dent", "staffing": "staffing staff", "laboratory": "laboratory lab labs", "housing": "housing hsg",
    "payment": "payment pymt pmt", "freight": "freight frt", "homecare": "homecare", "home": "home", "care": "care", "fitness": "fitness fit", "energy": "energy enrgy", "media": "media", "realty": "realty rlty", "jewelry": "jewelry jwlry", "foods": "foods food fds", "insurance": "insurance ins insur",
    "security": "security sec secur", "consulting": "consulting consltg conslt consult", "wireless": "wireless wrls", "education": "education ed educ", "environmental": "environmental env envir environ", "tobacco": "tobacco tob", "telecommunications": "telecommunications telecomm telecom tele",
    "pharmaceutical": "pharmaceutical pharma pharm", "manufacturing": "manufacturing mfg", "mortgage": "mortgage mtg mtge", "software": "software sftw softw", "chemical": "chemical chem",
}
#: Legal forms.
LEGAL = frozenset("llc lp inc ltd co corp limited company corporation incorporated llp plc pc na lllp gmbh sa".split())
#: Titles and additions without meaning for identity.
NOISE = frozenset("the mr mrs ms dr prof esq jr sr of hon".split())
ADDITION = re.compile(r",?\s*\b(?:et\.? al\b\.?|and (?:its|their|his|her) (?:affiliates|subsidiaries|related entities)|individually|an individual|d/?b/?a\b.*|a/?k/?a\b.*|f/?k/?a\b.*)|\((?:collectively|owner|individually|an individual|[^)]*)\)|&\s*co\b\.?(?=\s*(?:$|,|et\b|and\b|\())", re.I)
#: Given names and the nicknames that stand for them.
GIVEN = {
    "alexander": "alex al sandy xander", "anthony": "tony ant", "benjamin": "ben benji benny", "charles": "charlie chuck chas", "christina": "chris tina chrissy christy", "deborah": "deb debbie debby", "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted teddy",
    "elizabeth": "liz beth betsy betty eliza lizzie", "francis": "frank fran", "gabrielle": "gabby gabi", "gerald": "gerry jerry", "henry": "harry hank hal", "jennifer": "jen jenny jenn", "jonathan": "jon johnny nathan", "katherine": "kate kathy katie kat kathryn", "lawrence": "larry lars laurie",
    "margaret": "maggie meg peggy marge", "michael": "mike mick mickey", "patricia": "pat patty tricia trish", "rebecca": "becky becca", "richard": "rich rick dick ricky", "robert": "rob bob bobby robbie", "samuel": "sam sammy", "stephanie": "steph stephie", "susan": "sue susie suzy",
    "theodore": "theo ted teddy", "thomas": "tom tommy", "victoria": "vicky tori vicki", "william": "will bill billy willie", "james": "jim jimmy", "john": "jack johnny", "david": "dave", "joseph": "joe joey", "daniel": "dan danny", "barbara": "barb", "andrew": "andy drew",
}
#: Words of names that name nobody in particular.
NOBODY = frozenset("n/a tbd unknown various defendant defendants owner owners company companies respondent respondents none null the and others other unnamed individual individuals parties party doe does john jane et al to be determined named not disclosed withheld redacted multiple several corporation business person persons seller sellers two three four five brothers sisters couple an a men women people residents store stores website operators".split())

_WORD_OF = {a: ("K", k) for k, v in KINDS.items() for a in v.split()} | {a: ("B", k) for k, v in BUSINESS.items() for a in v.split()}
_NICK: dict[str, tuple] = {}
for _g, _v in GIVEN.items():
    for _n in (_g, *_v.split()):
        _NICK[_n] = tuple(sorted({*_NICK.get(_n, ()), _g}))
_FULL = {k for k in (*KINDS, *BUSINESS) if len(k) >= 5}


def osa(a: str, b: str, most: int = 2) -> int:
    """Edit distance with adjacent transpositions; most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1] if one[-1] <= most else most + 1


def nearest(word: str, among, most: int) -> str | None:
    """The one word of ``among`` with the least distance up to ``most``; None if there is none or several."""
    best, found = most + 1, []
    for w in among:
        if w[0] != word[0] and w[-1] != word[-1] and w[1:3] != word[1:3]:
            continue
        d = osa(word, w, most)
        if d < best:
            best, found = d, [w]
        elif d == best and d <= most:
            found.append(w)
    return found[0] if len(found) == 1 and best <= most else None


def _generic(w: str) -> tuple[str, str] | None:
    if w in _WORD_OF:
        return _WORD_OF[w]
    if len(w) >= 4:
        full = nearest(w, _FULL, 1 if len(w) < 7 else 2)
        if full:
            return _WORD_OF[full]
    return None


def parse(name: str | None) -> tuple | None:
    """Key of a name, None where it names nobody.

    ("O", distinctive, business, kind), ("P", surname, given or initial), or
    ("A", initials, "", "") of an organisation that is only initials.
    """
    s = (name or "").strip()
    if not s:
        return None
    s = ADDITION.sub(" ", s)
    s = re.sub(r"(?<=[a-z]{4})(?=[A-Z][a-z]{2})", " ", s)  # two words run together
    upper = s.upper() == s
    raw = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\.)", r"\1", s)  # L.L.C. -> LLC.
    toks = re.findall(r"[^\W_]+(?:'[^\W_]+)?", raw)
    low = [t.lower() for t in toks]
    if not low or all(t in NOBODY or t.isdigit() for t in low):
        return None
    legal = [t for t in low if t in LEGAL]
    rest = [(t, o) for t, o in zip(low, toks) if t not in LEGAL and t not in NOISE and t != "and"]
    if not rest or all(t in NOBODY or t.isdigit() for t, _ in rest):
        return None
    gen = [(_generic(t), t, o) for t, o in rest]
    kinds = [g[1] for g, _, _ in gen if g and g[0] == "K"]
    business = [g[1] for g, _, _ in gen if g and g[0] == "B"]
    other = [(t, o) for g, t, o in gen if not g]
    if len(rest) == 1 and len(rest[0][0]) <= 5 and legal and not kinds and not business:
        return ("A", rest[0][0], "", "")
    is_org = bool(kinds) or (bool(legal) and (bool(business) or len(other) == 1))
    if not is_org and legal and len(other) >= 2 and not any(t in _NICK for t, _ in other):
        is_org = True
    if is_org:
        # a distinctive word may be glued to a generic one
        if other and not business and kinds:
            t = max((t for t, _ in other), key=len)
            for k in sorted(_WORD_OF, key=len, reverse=True):
                if len(k) >= 4 and _WORD_OF[k][0] == "B" and t.endswith(k) and len(t) - len(k) >= 5:
                    business = [_WORD_OF[k][1]]
                    other = [(x[: -len(k)] if x == t else x, o) for x, o in other]
                    break
        word = "".join(t for t, _ in other)
        if not word:
            return None
        return ("O", word, " ".join(sorted(set(business))), " ".join(sorted(set(kinds))))
    # a person: one surname, perhaps a given name or initials in any order
    if "," in s and not upper:
        pass
    names = [t for t, _ in rest]
    long = [t for t in names if len(t) > 1]
    given = [t for t in long if t in _NICK]
    if not given:
        for t in long:
            g = nearest(t, GIVEN, 2 if len(t) >= 6 else 1) if len(t) >= 4 and len(long) > 1 else None
            if g:
                given = [t]
                break
    sur = [t for t in long if t not in given[:1]]
    if not sur:
        return None
    surname = "".join(sur) if len(sur) > 1 and max(map(len, sur)) < 9 else max(sur, key=len)
    if len(sur) > 1 and not given:
        surname = "".join(sur)
    if given:
        t = given[0]
        opts = _NICK.get(t) or (nearest(t, GIVEN, 2),)
        return ("P", surname, "/".join(opts))
    initials = [t for t in names if len(t) == 1]
    return ("P", surname, initials[0] if initials else "")


def _given_fits(a: str, b: str) -> bool:
    """Whether two given names, nicknames with several readings or initials may be one."""
    if not a or not b:
        return False
    if len(a) == 1 or len(b) == 1:
        return any(x[0] == y[0] for x in a.split("/") for y in b.split("/"))
    return bool({*a.split("/")} & {*b.split("/")})


def forms(word: str) -> set[str]:
    """The word and what is left of it without one or two of its letters; of long ones the deletions change no more than a slip does."""
    n = len(word)
    most = 2 if n >= 7 else 1 if n >= 4 else 0
    out = {word}
    for k in range(1, most + 1):
        for gone in combinations(range(n), k):
            out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict = {}
    for b in batches:
        out = []
        for col in ("raw_name", "canonical_name"):
            ks = []
            for x in b.column(col).to_pylist():
                if x not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[x] = parse(x)
                ks.append(memo[x])
            ks = ["|".join(k) if k else None for k in ks]
            out += [pa.array(ks, pa.string()), pa.array([_full(k) for k in ks], pa.bool_())]
        yield pa.RecordBatch.from_arrays([b.column("id"), *out], names=["id", "raw_key", "raw_full", "canon_key", "canon_full"])


def _full(k: str | None) -> bool:
    """A key that stands for one entity without help: an organisation with a kind, a person with a whole, unambiguous given name."""
    if not k:
        return False
    p = k.split("|")
    return p[0] == "O" or p[0] == "P" and len(p[2]) > 1 and "/" not in p[2]


def keyed(defendants: DataFrame) -> DataFrame:
    """(id, raw_key, raw_full, canon_key, canon_full); the keys of names that name nobody are null."""
    return defendants.select("id", "raw_name", "canonical_name").mapInArrow(_keys, f"id {dict(defendants.dtypes)['id']}, raw_key string, raw_full boolean, canon_key string, canon_full boolean")


def _spread(keys: DataFrame) -> DataFrame:
    """Distinct keys over all cores: few bytes become many forms."""
    return keys.repartition(max(keys.sparkSession.sparkContext.defaultParallelism, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "key")


def _large(side: DataFrame) -> DataFrame:
    """A side of a join that is sorted on both sides, never broadcast.

    A plan takes exploded rows for as large as the compressed keys that they
    are made of; broadcast on that guess, they would all pass the driver.
    """
    return side.hint("merge")


def _exploded(keys: DataFrame, column: str, make) -> DataFrame:
    """(column, part): what ``make`` lists for each key of a column, in Arrow batches."""

    def run(batches):
        for b in batches:
            parts = [(k, x) for k in b.column(0).to_pylist() for x in make(k)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.string()), pa.array([x for _, x in parts], pa.string())], names=[column, "part"])

    return keys.select(column).mapInArrow(run, f"{column} string, part string")


def _explode_forms(batches, initials: bool = True):
    """initials: whether persons meet under the initial of the given name, as open names need it, or under each of its readings."""
    for b in batches:
        f, k, w = [], [], []
        for key in b.column(0).to_pylist():
            p = key.split("|")
            # slips are sought within one line of business and kind, or under one given name
            tails = [f"{p[2]}|{p[3]}"] if p[0] == "O" else sorted({g[0] if initials else g for g in p[2].split("/")}) if p[2] else []
            for tail in tails:
                for x in forms(p[1]):
                    f.append(f"{p[0]}|{x}|{tail}")
                    k.append(key)
                    w.append(p[1])
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(k, pa.string()), pa.array(w, pa.string())], names=["form", "key", "word"])


def _confirm(batches):
    for b in batches:
        u, v, s = [], [], []
        for x, y, shared in zip(*(b.column(c).to_pylist() for c in ("a", "b", "shared"))):
            p, q = x.split("|"), y.split("|")
            n = min(len(p[1]), len(q[1]))
            d = osa(p[1], q[1], 2)
            if d > (2 if n >= 8 else 1 if n >= 5 else 0):
                continue
            if p[0] == "P" and (p[2] != q[2]) and not (_given_fits(p[2], q[2]) and len(p[2]) > 1 and len(q[2]) > 1):
                continue
            u.append(x)
            v.append(y)
            s.append(round(1.0 / shared / (1 + d), 4))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string()), pa.array(s, pa.float64())], names=["u", "v", "score"])


def key_links(keys: DataFrame) -> DataFrame:
    """(u, v, score) between different keys that a slip may have made of one; score: rarity of the rarest shared form over 1 + distance.

    Every two keys of a form meet and are confirmed or refused by their own
    distance.  The keys of a form that many share are dealt to tiles, and each
    pair of tiles is a group of its own, so that no task gets all of a form.
    """
    f = _spread(keys.select("key")).mapInArrow(partial(_explode_forms, initials=False), "form string, key string, word string").select("form", "key")
    shared = f.groupBy("form").agg(F.count("*").alias("shared")).where("shared > 1").withColumn("tiles", F.ceil(F.col("shared") / TILE).cast("int"))
    own, other = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    f = f.join(_large(shared), "form")
    left = f.select("form", "shared", F.col("key").alias("a"), own.alias("i"), other.alias("j"))
    right = f.select("form", F.col("key").alias("b"), other.alias("i"), own.alias("j"))
    pairs = left.join(_large(right), ["form", "i", "j"]).where("a < b").groupBy("a", "b").agg(F.min("shared").alias("shared"))
    return pairs.mapInArrow(_confirm, "u string, v string, score double")


def _confirm_open(batches):
    for b in batches:
        i, score = [], []
        for n, (x, y, shared) in enumerate(zip(*(b.column(c).to_pylist() for c in ("raw_key", "key", "shared")))):
            p, q = x.split("|"), y.split("|")
            d = osa(p[1], q[1], 2)
            if _given_fits(p[2], q[2]) and d <= (2 if min(len(p[1]), len(q[1])) >= 8 else 1):
                i.append(n)
                score.append(1.0 / shared / (1 + d))
        idx = pa.array(i, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("raw_key").take(idx), b.column("entity").take(idx), pa.array(score, pa.float64())], names=["raw_key", "entity", "score"])


def _best(scored: DataFrame) -> DataFrame:
    """(raw_key, entity) of the open names whose best entity leaves the next behind by ``MARGIN``."""
    one = scored.groupBy("raw_key", "entity").agg(F.max("score").alias("score"))
    top = one.groupBy("raw_key").agg(F.max(F.struct("score", "entity")).alias("b"))
    rest = one.join(_large(top), "raw_key").where(F.col("entity") != F.col("b.entity")).groupBy("raw_key").agg(F.max("score").alias("next"))
    return top.join(_large(rest), "raw_key", "left").where(F.col("b.score") >= MARGIN * F.coalesce("next", F.lit(0.0))).select("raw_key", "b.entity")


def entities(defendants: DataFrame) -> DataFrame:
    """(id, entity): the entity of each row that names somebody; entity is its smallest key.

    Null or empty names and rows that name nobody in particular have no row.
    Where the raw name alone fits several entities (initials of a company, an
    initial or an ambiguous nickname in place of a given name), the canonical
    name decides; without one the row joins the only entity that fits, if there
    is just one.
    """
    rows = cut(keyed(defendants).where("raw_key IS NOT NULL"))
    key = F.when(F.col("raw_full"), F.col("raw_key")).when(F.col("canon_full"), F.col("canon_key"))
    full = rows.withColumn("key", key)
    keys = cut(full.where("key IS NOT NULL").select(F.explode(F.array_compact(F.array("key", F.when(F.col("canon_full"), F.col("canon_key"))))).alias("key")).distinct())
    slips = key_links(keys).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    same_row = rows.where("raw_full AND canon_full AND raw_key <> canon_key").select(F.least("raw_key", "canon_key").alias("u"), F.greatest("raw_key", "canon_key").alias("v"))
    found = groups(slips.union(same_row).distinct())
    entity = cut(keys.join(_large(found.select(F.col("id").alias("key"), "group_id")), "key", "left").select("key", F.coalesce("group_id", "key").alias("entity")))
    sure = full.where("key IS NOT NULL").join(_large(entity), "key").select("id", "entity")
    # open names: join on what they do say, if only one entity says the same
    says = _exploded(entity, "key", _parts).join(_large(entity), "key").groupBy("part").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).where("entity = other").select("part", "entity")
    none = full.where("key IS NULL")
    exact = _exploded(none.select("raw_key").distinct(), "raw_key", _open_parts).join(_large(says), "part").groupBy("raw_key").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).where("entity = other").select("raw_key", "entity")
    # the surname may be misspelt, too: its forms meet those of the known keys
    loose = none.where("raw_key LIKE 'P|%'").join(_large(exact), "raw_key", "left_anti").select(F.col("raw_key").alias("key")).distinct()
    shape = "form string, key string, word string"
    theirs = _spread(entity.where("key LIKE 'P|%'").select("key")).mapInArrow(_explode_forms, shape).select("form", "key")
    shared = theirs.groupBy("form").agg(F.count("*").alias("shared"))
    near = _spread(loose).mapInArrow(_explode_forms, shape).select("form", F.col("key").alias("raw_key")).join(_large(theirs), "form").join(_large(shared), "form").groupBy("raw_key", "key").agg(F.min("shared").alias("shared"))
    close = _best(near.join(_large(entity), "key").select("raw_key", "key", "entity", "shared").mapInArrow(_confirm_open, "raw_key string, entity string, score double"))
    known = cut(exact.union(close))
    open_ = none.join(_large(known), "raw_key").select("id", "entity")
    # open names that fit no known entity are one among themselves if they are spelt alike
    left = none.where("raw_key NOT LIKE 'A|%'").join(_large(known.select("raw_key")), "raw_key", "left_anti").select("id", F.concat(F.lit("~"), "raw_key").alias("entity"))
    return sure.union(open_).union(left)


def _parts(key: str) -> list[str]:
    """What an open name could say of this key."""
    p = key.split("|")
    if p[0] == "O":
        return ["A|" + p[1][0] + "".join(x[0] for x in _in_order(p[2])) + "".join(x[0] for x in p[3].split())]
    if len(p[2]) > 1 and "/" not in p[2]:
        return [f"P|{p[1]}|{p[2][0]}", f"P|{p[1]}|{p[2]}", f"P|{p[1]}|"]
    return []


def _in_order(business: str) -> list[str]:
    return ["home", "care"] if business == "care home" else business.split()


def _open_parts(key: str) -> list[str]:
    p = key.split("|")
    if p[0] == "A":
        return [f"A|{p[1]}"]
    return [f"P|{p[1]}|{g}" for g in p[2].split("/")]


def pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b) of different rows of one entity; the join on the entity is split by adaptive execution where it is hot."""
    a, b = found.select(F.col("id").alias("id_a"), "entity"), found.select(F.col("id").alias("id_b"), "entity")
    return a.join(_large(b), "entity").where("id_a < id_b").select("id_a", "id_b")
