"""The queries opN_<name>, by name, and DuckDB SQL for those that SQL can express."""

from . import decontaminate, langid, linededup, media, mixing, pii, quality, simhash, substrings, tokens

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_files": tokens.op4_token_files,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_media": media.op7_media,
    "op8_language_id": langid.op8_language_id,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_simhash": simhash.op10_simhash,
}
ORACLE: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op6_line_dedup": linededup.ORACLE}
