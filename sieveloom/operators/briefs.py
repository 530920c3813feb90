"""Briefs and styles: validation as predicates, and the prompts that they make."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRIEF_KEYS = {"intent", "audience", "token", "surfaces", "mustInclude", "mustAvoid"}
SURFACES = {"web", "social", "print", "email", "slides", "image", "app"}
TARGETS = ("claude", "gpt", "gemini", "generic")
_RULES = (
    "Name, in a comment beside it, the rule of the brief that each decision follows.",
    "What the list of forbidden things names counts as a fault: if one comes to mind, choose another way.",
)


def brief_problems(brief: dict, surfaces: set[str] | None = None) -> list[str]:
    """What is wrong with a brief: unknown keys, missing texts, empty or unknown surfaces, lists of other things than texts."""
    out = [f"unknown key {k}" for k in sorted(set(brief) - BRIEF_KEYS)]
    if not isinstance(brief.get("intent"), str) or not brief["intent"]:
        out.append("intent")
    if "token" in brief and not (isinstance(brief["token"], str) and re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", brief["token"])):
        out.append("token")
    given = brief.get("surfaces")
    if not isinstance(given, list) or not given or any(s not in (surfaces or SURFACES) for s in given):
        out.append("surfaces")
    return out + [k for k in ("mustInclude", "mustAvoid") if k in brief and not (isinstance(brief[k], list) and all(isinstance(x, str) for x in brief[k]))]


def style_problems(style: dict) -> list[str]:
    """What is wrong with a style, as far as its required parts go."""
    out = [k for k in ("id", "name", "version", "type", "colour", "grid", "space", "surface", "required-quirks", "prompt-fragments") if k not in style]
    if not isinstance(style.get("forbidden"), list) or len(style["forbidden"]) < 8:
        out.append("forbidden")
    colour = style.get("colour") or {}
    if colour.get("space") != "oklch" or colour.get("contrast-tier") not in ("WCAG-AA", "WCAG-AAA"):
        out.append("colour")
    fragments = style.get("prompt-fragments") or {}
    return list(dict.fromkeys(out + [f"prompt-fragments.{k}" for k in ("system", "negative") if not isinstance(fragments.get(k), str)]))


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(problem): the missing fields of a manifest (token, briefPath, n, models as JSON columns), model numbers left out, each once."""
    top = F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in ("token", "briefPath", "n", "maxTokens", "runAt")), F.when(F.col("models").isNull() | (F.size("models") < 1), F.lit("models")))
    inner = F.transform(F.coalesce("models", F.array().cast(manifest.schema["models"].dataType)), lambda m: F.array(*(F.when(m[k].isNull(), F.lit(f"models[].{k}")) for k in ("spec", "canonicalId", "sanitizedId", "provider"))))
    return manifest.select(F.explode(F.array_compact(F.concat(top, F.flatten(inner)))).alias("problem")).distinct()


def prose_column(intent, audience, surfaces, must_include, must_avoid):
    """``as_prose`` as a column of the parts' columns; null and empty parts are left out."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    listed = lambda head, c: F.when(some(c), F.concat(F.lit(f"{head}\n- "), F.array_join(c, "\n- ")))
    return F.concat_ws("\n", F.concat(F.lit("Design intent: "), F.trim(intent)), F.when(audience != "", F.concat(F.lit("Audience: "), F.trim(audience))), F.when(some(surfaces), F.concat(F.lit("Surfaces: "), F.array_join(surfaces, ", "))), listed("Must include:", must_include), listed("Must avoid:", must_avoid))


def issue_groups(issues: DataFrame) -> DataFrame:
    """(field, n): missing fields (path) of a submission, with the numbers of models left out, and how often each is missing."""
    return issues.groupBy(F.regexp_replace("path", r"^models\.\d+\.", "models[].").alias("field")).agg(F.count("*").alias("n"))


def critic_prompts(rules: DataFrame) -> DataFrame:
    """(prompt): ``critic_prompt`` of a table of rules, by id. Rules are a small table."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "description"))), lambda r: F.concat(F.lit("- "), r["rule_id"], F.lit(": "), r["description"])), "\n")
    return rules.agg(F.concat(F.lit(_CRITIC + "\n"), lines).alias("prompt"))


def as_prose(brief: dict) -> str:
    parts = [f"Design intent: {brief['intent'].strip()}"]
    parts += [f"Audience: {brief['audience'].strip()}"] if brief.get("audience") else []
    parts += [f"Surfaces: {', '.join(brief['surfaces'])}"] if brief.get("surfaces") else []
    for head, key in (("Must include:", "mustInclude"), ("Must avoid:", "mustAvoid")):
        if brief.get(key):
            parts += [head, *(f"- {x}" for x in brief[key])]
    return "\n".join(parts)


def spec_of(brief: dict, style: dict) -> dict:
    spec = {"intent": brief["intent"], "audience": brief.get("audience"), "surfaces": brief["surfaces"], "token": {k: style.get(k) for k in ("id", "name", "version")}}
    spec |= {k: style.get(k) for k in ("type", "colour", "grid", "space", "surface")}
    spec |= {"forbidden": style["forbidden"] + (brief.get("mustAvoid") or []), "required": style["required-quirks"] + (brief.get("mustInclude") or []), "copy": style.get("copy")}
    return {k: v for k, v in spec.items() if v is not None}


def compiled(brief: dict, style: dict, final: bool = False) -> dict:
    """``spec`` and a prompt for each target, for drafts (several directions) or for the final page (one document)."""
    spec = spec_of(brief, style)
    last = "Answer with one whole HTML document and nothing else." if final else "Sketch three directions that differ before choosing one, and say what each draws on."
    rules = "\n".join(f"- {r}" for r in (*_RULES, f'Put <meta name="style-token" content="{style["id"]}"> in the head.', "Motion of more than 200 ms needs a variant for reduced motion.", last, "Keep at least one of the required quirks."))
    prompt = lambda target: "\n\n".join((f"# Prompt for {target} ({'final' if final else 'draft'})", f"## Style\n{style['prompt-fragments']['system'].strip()}", f"## Forbidden\n{style['prompt-fragments']['negative'].strip()}", f"## Brief\n{as_prose(brief)}", f"## Specification\n{json.dumps(spec, indent=2, ensure_ascii=False)}", f"## Rules\n{rules}"))
    return {"spec": spec, "prompts": {t: prompt(t) for t in TARGETS}}


def image_prompt(brief: dict, style: dict, most: int = 2000) -> dict[str, str]:
    """The prompt of an image model with the style, and the one without."""
    palette = ", ".join((style.get("colour", {}).get("palette") or {}).values())
    parts = [brief["intent"].strip(), style["prompt-fragments"]["system"].strip(), f"Palette: {palette}" if palette else "", f"Avoid: {', '.join(spec_of(brief, style)['forbidden'])}"]
    return {"raw": as_prose(brief)[:most], "compiled": ". ".join(p for p in parts if p)[:most]}


_CRITIC = 'Look at the image and say which of these apply. Answer with JSON: {"fired": [ids], "rationale": {id: reason}}.'


def critic_prompt(rules: list[tuple[str, str]]) -> str:
    listed = "\n".join(f"- {i}: {d}" for i, d in rules)
    return f"{_CRITIC}\n{listed}"
