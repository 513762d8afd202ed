"""Training records, prompts and token arrays as column expressions. Numbers are rounded as Python renders them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Instruction and frame that models were trained on.
INSTRUCTION = "Analyze this Danish National Travel Survey entry for logical errors."
FRAME = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request."
RAG_INSTRUCTION = (
    "Validate this trip. Compare 'System Used Coords' vs 'Verified Coords'.\n"
    "If System Coords are >1km from Verified Coords (and Confidence >0.75), flag as INVALID COORDINATES.\n"
    "Otherwise, check speed/distance logic."
)
FINE = "The reported metrics are consistent with the transport mode and system calculations."
SPEEDING = ("Speed is unrealistic. ", " km/h is too fast for mode '", "'.")
MISPLACED = "Coordinate mismatch. The geocoded location is inconsistent with the address."
NOWHERE, GENERAL = "Zero distance error.", "General data inconsistency detected."


_STATED = ["__km", "__minutes", "__kmh", "__kmh1", "__kmh0", "__system1", "__gap1"]


def _stated(df: DataFrame) -> DataFrame:
    """Add the numbers that prompts tell, and how they are written; each in a column, so that it is computed once."""
    km, minutes, system = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("stagelength_raw", "stagedurationmin_raw", "calc_dist_geo"))
    out = df.withColumns({"__km": km, "__minutes": minutes, "__system": system})
    out = out.withColumns({"__kmh": F.when(F.col("__minutes") > 0, F.col("__km") / (F.col("__minutes") / 60)).otherwise(F.lit(0.0)), "__gap": F.abs(F.col("__km") - F.col("__system"))})
    return out.withColumns({"__kmh1": tx.fixed(F.col("__kmh"), 1), "__kmh0": tx.fixed(F.col("__kmh"), 0), "__system1": tx.fixed(F.col("__system"), 1), "__gap1": tx.fixed(F.col("__gap"), 1)}).drop("__system", "__gap")


def _body(start: Column, end: Column) -> Column:
    """The description of a trip that training and inference share, of columns that ``_stated`` adds."""
    mode = F.col("transportmiddel")
    return F.concat(
        F.lit("Trip Mode: "), tx.mode_label(mode), F.lit(" (Code "), F.coalesce(mode.cast("string"), F.lit("nan")), F.lit(")\n"),
        F.lit("From: "), start, F.lit("\nTo: "), end, F.lit("\nUser Reported: "), F.col("__km").cast("string"), F.lit(" km in "), F.col("__minutes").cast("string"), F.lit(" min "),
        F.lit("(Calculated Speed: "), F.col("__kmh1"), F.lit(" km/h)\nSystem Calculated Distance: "), F.col("__system1"), F.lit(" km\nDiscrepancy: "), F.col("__gap1"), F.lit(" km difference."),
    )


def training_entry(df: DataFrame) -> DataFrame:
    """Add instruction, input and output; the label follows validation_status, whatever the flags say."""
    said = F.concat_ws(
        " ",
        F.when(F.col("flag_speed_bad"), F.concat(F.lit(SPEEDING[0]), F.col("__kmh0"), F.lit(SPEEDING[1]), tx.mode_label(F.col("transportmiddel")), F.lit(SPEEDING[2]))),
        F.when(F.col("flag_coords_bad"), F.lit(MISPLACED)),
        F.when(F.col("flag_zero_dist"), F.lit(NOWHERE)),
    )
    wrong = (F.col("validation_status") == "hard_wrong") | ((F.col("validation_status") != "trusted") & (F.col("__said") != ""))
    text = lambda c: F.coalesce(F.col(c), F.lit("nan"))
    return _stated(df).withColumn("__said", said).withColumns({
        "instruction": F.lit(INSTRUCTION),
        "input": _body(text("startTripText_raw"), text("tiladrtext_raw")),
        "output": F.when(wrong, F.concat(F.lit("Verdict: INVALID\nAnalysis: "), F.when(F.col("__said") == "", GENERAL).otherwise(F.col("__said")))).otherwise(f"Verdict: VALID\nAnalysis: {FINE}"),
    }).drop(*_STATED, "__said")


def prompt(df: DataFrame, out: str = "prompt_text") -> DataFrame:
    """Add the prompt for inference; missing texts have names of their own."""
    told = _body(F.coalesce("startTripText_raw", F.lit("Unknown Start")), F.coalesce("tiladrtext_raw", F.lit("Unknown Dest")))
    return _stated(df).withColumn(out, F.concat(F.lit(f"{FRAME}\n\n### Instruction:\n{INSTRUCTION}\n\n### Input:\n"), told, F.lit("\n\n### Response:\n"))).drop(*_STATED)


def rag_prompt(df: DataFrame, out: str = "rag_prompt_text") -> DataFrame:
    """Add the prompt with each end's matched address, confidence and coordinates."""

    def place(title: str, text: str, p: str, lat: str, lon: str) -> Column:
        n = lambda c, places: tx.fixed(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), places)
        return F.concat(
            F.lit(f"--- {title} LOCATION ---\nUser Input: '"), F.coalesce(F.col(text), F.lit("")), F.lit("'\nVerified Database Match: '"), F.coalesce(F.col(f"{p}_text"), F.lit("")), F.lit("' (Confidence: "), n(f"{p}_score", 2),
            F.lit(")\nVerified Coords: ("), n(f"{p}_lat", 4), F.lit(", "), n(f"{p}_lon", 4), F.lit(")\nSystem Used Coords: ("), n(lat, 4), F.lit(", "), n(lon, 4), F.lit(")\n"),
        )

    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    told = F.concat(
        F.lit("Trip Mode: "), F.coalesce(F.col("transportmiddel").cast("string"), F.lit("Unknown")), F.lit("\n"),
        place("START", "startTripText_raw", "rag_start", "start_lat", "start_lon"), place("END", "tiladrtext_raw", "rag_end", "til_lat", "til_lon"),
        F.lit("--- METRICS ---\nReported Dist: "), s("stagelength_raw"), F.lit(" km\nSystem Calc Dist: "), s("calc_dist_geo"), F.lit(" km"),
    )
    return df.withColumn(out, F.concat(F.lit(f"{FRAME}\n### Instruction:\n{RAG_INSTRUCTION}\n\n### Input:\n"), told, F.lit("\n\n### Response:\n")))


def formatted(instruction: Column, input: Column, output: Column, end: str = "</s>") -> Column:
    return F.concat(F.lit(f"{FRAME}\n\n### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), input, F.lit("\n\n### Response:\n"), output, F.lit(end))


def labels(prompt_ids: Column, response_ids: Column, ignored: int = -100) -> Column:
    """Response ids, after as many ignored labels as the prompt has ids."""
    return F.concat(F.array_repeat(F.lit(ignored), F.size(prompt_ids)), response_ids)


def truncated(prompt_ids: Column, response_ids: Column, most: int) -> Column:
    """The prompt's beginning and the whole response; a response longer than ``most`` stays longer."""
    return F.concat(F.slice(prompt_ids, 1, F.greatest(F.lit(most) - F.size(response_ids), F.lit(0))), response_ids)


def padded(df: DataFrame, ids: str, batch: str, pad: int = 0, ignored: int = -100, multiple: int = 8) -> DataFrame:
    """Add padded ids, attention_mask and labels, up to the batch's longest row rounded up to a multiple."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    more = (F.ceil(longest / multiple) * multiple).cast("int") - F.size(ids)
    return df.withColumns({
        "input_ids": F.concat(F.col(ids), F.array_repeat(F.lit(pad), more)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), more)),
        "labels": F.concat(F.col(ids), F.array_repeat(F.lit(ignored), more)),
    })
