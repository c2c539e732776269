"""The registered queries of this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from .ann import op10_ann
from .decontaminate import op5_decontaminate
from .dedup import op1_dedup
from .html import op9_html
from .langid import op2_langid
from .licenses import op8_licenses
from .lm import op7_lm
from .mix import ORACLE_SQL, op3_mix
from .pii import op4_pii
from .warc import op6_warc

QUERIES = {"op1_dedup": op1_dedup, "op2_langid": op2_langid, "op3_mix": op3_mix, "op4_pii": op4_pii, "op5_decontaminate": op5_decontaminate, "op6_warc": op6_warc, "op7_lm": op7_lm, "op8_licenses": op8_licenses, "op9_html": op9_html, "op10_ann": op10_ann}

ORACLES: dict[str, str] = {"op3_mix": ORACLE_SQL}
