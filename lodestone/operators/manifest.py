"""Checks of cartridges' manifests, over all cartridges at once.

A manifest is what the YAML scan gives: (cartridge, entries); files are (cartridge, file), paths below the cartridge. A check that finds a fault gives
(cartridge, check, level): an error, or a warning for what is only ignored. Names and slots that entries refer to are joined with the files.

Defined cases: a manifest without entries lacks its name, version and prompts; a cartridge without files has none of those it names; of entries with
one path the last counts; null entries are no entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of a name, the slots of prompts, and what a plain scalar reads as when it is no text.
NAME = r"^[a-z0-9][a-z0-9-]{1,40}$"
SLOTS = ("intent", "qna", "action", "plan", "playbook", "system")
NO_TEXT = r"^[-+]?[0-9][0-9_]*(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?$|^(?i:true|false|yes|no|on|off)$"


def problems(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(cartridge, check, level) of every fault."""
    m = manifests.select("cartridge", F.coalesce("entries", F.array().cast("array<struct<path:string,value:string,plain:boolean>>")).alias("entries"))

    def last(path: str) -> Column:
        return F.try_element_at(F.filter("entries", lambda e: e["path"] == path), F.lit(-1))

    below = lambda path: F.exists("entries", lambda e: e["path"].startswith(f"{path}.") | e["path"].startswith(f"{path}["))
    text = lambda e: e["value"].isNotNull() & ~(e["plain"] & e["value"].rlike(NO_TEXT))
    missing = lambda path: ~F.coalesce(text(last(path)), F.lit(False))
    fault = lambda when, check, level="error": F.when(when, F.struct(F.lit(check).alias("check"), F.lit(level).alias("level")))

    slots = F.array_distinct(F.transform(F.filter("entries", lambda e: e["path"].rlike(r"^prompts\.[^.\[]+")), lambda e: F.regexp_extract(e["path"], r"^prompts\.([^.\[]+)", 1)))
    no_slot = ~F.exists(slots, lambda s: s.isin(*SLOTS))
    counts = F.filter("entries", lambda e: e["path"].startswith("knowledge.breakdown."))
    plugins = F.array_distinct(F.transform(F.filter("entries", lambda e: e["path"].startswith("plugins[")), lambda e: F.regexp_extract(e["path"], r"^(plugins\[[0-9]+\])", 1)))
    of = lambda path: F.exists("entries", lambda e: (e["path"] == path) & text(e))
    each = F.array_compact(F.array(
        fault(missing("name") | ~F.coalesce(last("name")["value"].rlike(NAME), F.lit(False)), "name"),
        fault(missing("version"), "version"),
        fault(no_slot, "prompts"),
        fault((last("knowledge")["value"].isNotNull()) | (below("knowledge") & missing("knowledge.dir")), "knowledge.dir"),
        fault(F.exists(counts, lambda e: ~F.coalesce(e["plain"] & e["value"].rlike("^[-+]?[0-9]+$"), F.lit(False))), "knowledge.breakdown", "warning"),
        fault((last("model")["value"].isNotNull()) | (below("model") & missing("model.recommended")), "model.recommended"),
        fault(last("plugins")["value"].isNotNull() | below("plugins") & (F.size(plugins) == 0), "plugins"),
    ))
    odd = F.transform(F.filter(slots, lambda s: ~s.isin(*SLOTS)), lambda s: F.struct(F.concat(F.lit("prompts."), s).alias("check"), F.lit("warning").alias("level")))
    lacking = F.flatten(F.transform(plugins, lambda p: F.transform(F.filter(F.array(F.lit("name"), F.lit("path")), lambda k: ~of(F.concat(p, F.lit("."), k))), lambda k: F.struct(F.concat(p, F.lit("."), k).alias("check"), F.lit("error").alias("level")))))
    own = m.select("cartridge", F.inline(F.concat(each, odd, lacking)))

    # What a manifest names has to be there: prompts and plugins as files or folders, the knowledge folder as a folder.
    named = m.select("cartridge", F.explode("entries").alias("e")).where(F.col("e.value").isNotNull())
    path = F.col("e.path")
    slot = path.rlike(rf"^prompts\.(?:{'|'.join(SLOTS)})$")
    asked = named.where(slot | (path == "knowledge.dir") | path.rlike(r"^plugins\[[0-9]+\]\.path$")).select("cartridge", path.alias("check"), F.regexp_replace("e.value", "^(?:\\./)+|/+$", "").alias("file"), slot.alias("slot"))
    parts = F.split("file", "/")
    folders = files.select("cartridge", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, 1, n), "/")))).alias("file")).where("file IS NOT NULL").distinct()
    there = files.select("cartridge", "file", F.lit(False).alias("folder")).distinct().unionByName(folders.select("cartridge", "file", F.lit(True).alias("folder")))
    fits = (asked["cartridge"] == there["cartridge"]) & (asked["file"] == there["file"]) & F.when(asked["slot"], ~there["folder"]).when(asked["check"] == "knowledge.dir", there["folder"]).otherwise(F.lit(True))
    gone = asked.join(there, fits, "left_anti").select("cartridge", "check", F.when(F.col("check").startswith("plugins"), "warning").otherwise("error").alias("level"))
    return own.unionByName(gone).distinct()
