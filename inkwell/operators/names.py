"""Resolving mentions to known entities, and schema keys to canonical keys."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T

#: Mentions that name nobody by themselves.
MENTIONS = (
    "나", "나는", "내가", "나를", "나에게", "내", "내게", "나의", "내 캐릭터", "저", "저는", "제가", "저를", "저에게", "제", "주인공", "그", "그는", "그가", "그를", "그에게", "그의",
    "그녀", "그녀는", "그녀가", "그녀를", "그녀에게", "그녀의", "그 남자", "그 여자", "그 아이", "그 사람", "이 사람", "저 사람",
)
#: Stand-ins for a missing name.
PLACEHOLDERS = ("미상", "불명", "불명확", "알 수 없음", "추론 불가", "unknown")
#: Particles that may follow a mention.
PARTICLES = ("에게서", "한테서", "에게", "한테", "께", "으로", "로", "은", "는", "이", "가", "을", "를", "의", "도")
#: Fixed value: quotes and brackets around a name.
AROUND = "\"'`“”‘’()[]{}<>〈〉《》"
UNKNOWN = PLACEHOLDERS[0]
_AROUND = "[" + "".join("\\" + c if c in "[](){}\"'<>`" else c for c in AROUND) + "]"
_MENTION = f"(?:{'|'.join(MENTIONS)})"
_PARTICLE = f"(?:{'|'.join(PARTICLES)})"


def normalize(c: Column) -> Column:
    """White space stripped, quotes and brackets stripped, runs of white space as one blank, case folded; null is empty."""
    bare = F.regexp_replace(T.strip(F.coalesce(c, F.lit(""))), f"^{_AROUND}+|{_AROUND}+$", "")
    return T.fold(T.squeeze(bare))


def is_mention(name: Column) -> Column:
    """A mention with any number of particles behind it (name is normalised)."""
    return name.rlike(rf"^{_MENTION}{_PARTICLE}*\z")


def is_concrete(name: Column) -> Column:
    return (name != "") & ~name.isin(*PLACEHOLDERS) & ~is_mention(name)


def is_usable(name: Column) -> Column:
    """A name that may be kept as it is: concrete, or a new name that only looks like a one-letter mention with a particle."""
    particle_on_mention = F.lit(False)
    for p in PARTICLES:
        rest = name.substr(F.lit(1), F.length(name) - len(p))
        particle_on_mention = particle_on_mention | (name.endswith(p) & (F.length(name) - len(p) > 1) & is_mention(rest))
    return is_concrete(name) | ((name != "") & ~name.isin(*PLACEHOLDERS, *MENTIONS) & ~particle_on_mention)


def known(entities: DataFrame, id_col: str, name_col: str, work_col: str | None = None) -> DataFrame:
    """(work, known_id, known_name) with normalised names, empty ones left out. Names only match within a work; without a column for it all are of one."""
    work = F.col(work_col).cast("string") if work_col else F.lit("")
    return entities.select(work.alias("work"), F.col(id_col).alias("known_id"), normalize(F.col(name_col)).alias("known_name")).filter("known_name <> ''").distinct()


def _exact(rows: DataFrame, name: str, entities: DataFrame, out: str) -> DataFrame:
    found = rows.select("row_id", _work(rows), F.col(name).alias("known_name")).filter(F.col(name) != "").join(entities.select(_work(entities), "known_name", "known_id"), ["work", "known_name"])
    return found.groupBy("row_id").agg(F.sort_array(F.collect_set("known_id")).alias(out))


def _work(rows: DataFrame) -> Column:
    """A work as a key that joins: null is a work of its own, told from the empty one."""
    return F.coalesce(F.concat(F.lit("="), rows["work"]), F.lit("")).alias("work")


#: Names of a work that one automaton holds; a work with more is dealt in blocks, each against each.
BLOCK = 200_000


def automaton(names: list[str]):
    """Aho-Corasick over distinct names, each standing for its place in the list; None without any."""
    out = ahocorasick.Automaton()
    for i, n in enumerate(names):
        out.add_word(n, i)
    if not names:
        return None
    out.make_automaton()
    return out


def _hits(names: list[str], texts: list[str]) -> set[tuple[int, int]]:
    """(place of a name, place of a text that holds it): one pass over each text."""
    found = automaton(names)
    return {(i, j) for j, t in enumerate(texts) for _, i in found.iter(t)} if found else set()


def contained_names(names: DataFrame, entities: DataFrame, block: int = BLOCK) -> DataFrame:
    """(work, n, ids) of names (work, n): ids of the known names of the work of which one holds the other, both of at least two characters.

    For each work an automaton over the known names reads the distinct names, and one over the names reads the known ones, so the work is
    linear in their lengths and the hits, whatever beginnings names share. Works are keys of a cogroup; a work with more than `block`
    names on a side is cut by hash, and each part meets each part of the other side.
    """
    left = names.select(_work(names), "n").filter(F.length("n") >= 2).distinct()
    right = entities.select(_work(entities), "known_name", "known_id").filter(F.length("known_name") >= 2)
    sizes = left.select("work", F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select("work", F.lit(0), F.lit(1))).groupBy("work").agg(F.ceil(F.sum("l") / block).alias("parts"), F.ceil(F.sum("r") / block).alias("blocks")).filter("parts > 0 and blocks > 0")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = left.join(sizes, "work").select("work", "n", part("n", "parts").alias("part"), every("blocks").alias("block"))
    right = right.join(sizes, "work").select("work", "known_name", "known_id", part("known_name", "blocks").alias("block"), every("parts").alias("part"))

    def meet(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        texts = own["n"].tolist()
        by_name = known.groupby("known_name", sort=False)["known_id"].agg(list)
        held = by_name.index.tolist()
        met: dict[int, set[int]] = {}
        for k, t in _hits(held, texts):
            met.setdefault(t, set()).add(k)
        for t, k in _hits(texts, held):
            met.setdefault(t, set()).add(k)
        rows = [(texts[t], sorted({i for k in ks for i in by_name.iloc[k]})) for t, ks in met.items()]
        return pd.DataFrame({"work": own["work"].iloc[0] if len(own) else None, "n": [r[0] for r in rows], "ids": [r[1] for r in rows]})

    keys, kind = ["work", "part", "block"], right.schema["known_id"].dataType.simpleString()
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"work string, n string, ids array<{kind}>")
    # parts of one name come from different blocks, and no known name is in two
    return found.groupBy("work", "n").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def contained(rows: DataFrame, name: str, entities: DataFrame, out: str) -> DataFrame:
    """(row_id, out): contained_names() of the column `name` of rows (row_id, work, ...)."""
    own = rows.select("row_id", _work(rows), F.col(name).alias("n"))
    return own.join(contained_names(rows.select("work", F.col(name).alias("n")), entities), ["work", "n"]).select("row_id", F.col("ids").alias(out))


def resolve(rows: DataFrame, entities: DataFrame, kind: str = "SETTING", work_col: str | None = None) -> DataFrame:
    """rows (entity_name, raw_mention[, candidate_kind]) with matched_id and match_status; work_col is the column of the work of a row.

    Rules in order: the entity name must be concrete, or an exact known name that is no bare mention; discoveries go by the
    entity alone; so do mentions that are pronouns; then the raw mention decides, and contradictions are AMBIGUOUS.

    Every distinct name of a work is looked up once, and all columns of a row travel as one struct: rows may repeat, and their columns may
    have any names. A null work is a work of its own, in which the known entities without a work are.
    """
    work = F.col(work_col).cast("string") if work_col else F.lit("")
    given = F.col("candidate_kind") if "candidate_kind" in rows.columns else F.lit(kind)
    base = rows.select(F.struct("*").alias("_row"), normalize(F.col("entity_name")).alias("e"), normalize(F.col("raw_mention")).alias("r"), work.alias("work"), given.alias("candidate_kind"))
    base = base.select("_row", "e", "r", _work(base), "candidate_kind")
    looked = base.select("work", F.explode(F.array("e", "r")).alias("n")).filter("n <> ''").distinct()
    plain = looked.select(F.when(F.col("work") != "", F.expr("substring(work, 2)")).alias("work"), "n")
    exact = looked.join(entities.select(_work(entities), F.col("known_name").alias("n"), "known_id"), ["work", "n"]).groupBy("work", "n").agg(F.sort_array(F.collect_set("known_id")).alias("exact"))
    found = exact.join(contained_names(plain, entities), ["work", "n"], "full_outer")
    for c in ("e", "r"):
        base = base.join(found.select("work", F.col("n").alias(c), F.col("exact").alias(f"{c}_exact"), F.col("ids").alias(f"{c}_part")), ["work", c], "left")
    empty = F.array().cast("array<string>")
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("string")), empty)
    e_exact = ids("e_exact")
    e_ids, r_ids = F.array_union(e_exact, ids("e_part")), F.array_union(ids("r_exact"), ids("r_part"))
    concrete = is_concrete(F.col("e")) | ((F.size(e_exact) > 0) & ~F.col("e").isin(*PLACEHOLDERS, *MENTIONS))
    pronoun = is_mention(F.col("r"))
    base = base.withColumns({"e_ids": e_ids, "r_ids": r_ids, "concrete": concrete, "pronoun": pronoun})
    of = lambda status, i=None: F.struct((F.lit(None).cast("string") if i is None else i).alias("matched_id"), F.lit(status).alias("match_status"))
    first = lambda c: F.get(c, 0)
    by_entity = F.when(F.size("e_ids") > 1, of("AMBIGUOUS")).when(F.size("e_ids") == 1, of("MATCHED", first("e_ids"))).otherwise(of("UNRESOLVED"))
    result = (
        F.when(~F.col("concrete"), of("AMBIGUOUS"))
        .when((F.col("candidate_kind") == "CHARACTER_DISCOVERY") | F.col("pronoun"), by_entity)
        .when((F.size("e_ids") == 0) & F.col("r").contains(F.col("e")), of("UNRESOLVED"))
        .when(F.size("r_ids") > 1, of("AMBIGUOUS"))
        .when((F.size("r_ids") == 1) & (F.size("e_ids") == 1) & (first("e_ids") != first("r_ids")), of("AMBIGUOUS"))
        .when(F.size("r_ids") == 1, of("MATCHED", first("r_ids")))
        .otherwise(by_entity)
    )
    return base.select("_row", result.alias("m")).select("_row.*", "m.matched_id", "m.match_status")


def canonical_keys(rows: DataFrame, schemas: DataFrame, key_col: str = "attribute_name") -> DataFrame:
    """rows with canonical_key: the only schema whose key is equal, else the only one with that alias (bare, or behind the
    schema's namespace), else the stripped key. A key that several schemas share stays as it is. Aliases with dots are ignored.

    schemas: (schema_key, aliases), the few schemas of a work.
    """
    numbered = schemas.select(F.monotonically_increasing_id().alias("schema"), T.strip(F.col("schema_key")).alias("key"), "aliases")
    exact = numbered.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n_exact"), F.min("key").alias("exact"))
    space = F.regexp_extract("key", r"(?s)^(.*\.)[^.]*\z", 1)
    named = numbered.select("schema", "key", space.alias("space"), F.explode("aliases").alias("alias")).withColumn("alias", T.strip(F.col("alias"))).filter((F.col("alias") != "") & ~F.col("alias").contains("."))
    forms = named.select("schema", "key", F.explode(F.array("alias", F.concat("space", "alias"))).alias("k")).distinct()
    alias = forms.groupBy("k").agg(F.count(F.lit(1)).alias("n_alias"), F.min("key").alias("alias_of"))
    exact, alias = (x.select(*(F.col(c).alias(f"_ink_{c}") for c in x.columns)) for x in (exact, alias))
    own = rows.withColumn("_ink_k", T.strip(F.col(key_col)))
    e, k = F.col, F.col("_ink_k")
    pick = F.when(e("_ink_n_exact") == 1, e("_ink_exact")).when(e("_ink_n_exact") > 1, k).when(e("_ink_n_alias") == 1, e("_ink_alias_of")).otherwise(k)
    met = own.join(exact, "_ink_k", "left").join(alias, "_ink_k", "left").withColumn("canonical_key", pick)
    return met.select(*(own[c] for c in rows.columns if c != "canonical_key"), "canonical_key")
