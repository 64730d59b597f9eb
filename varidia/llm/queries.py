"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from .audio import op2_audio
from .chat import OP9_SQL, op9_chat
from .collocations import OP12_SQL, op12_collocations
from .divergence import OP11_SQL, op11_divergence
from .htmltext import op10_htmltext
from .langid import op6_langid
from .lmscore import op3_lmscore
from .mixing import OP8_SQL, op8_mixing
from .neardup import op7_neardup
from .packing import op1_packing
from .phrases import op5_phrases
from .quality import op4_quality
from .toxicity import op13_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_audio": op2_audio,
    "op3_lmscore": op3_lmscore,
    "op4_quality": op4_quality,
    "op5_phrases": op5_phrases,
    "op6_langid": op6_langid,
    "op7_neardup": op7_neardup,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_htmltext": op10_htmltext,
    "op11_divergence": op11_divergence,
    "op12_collocations": op12_collocations,
    "op13_toxicity": op13_toxicity,
}

ORACLES = {"op8_mixing": OP8_SQL, "op9_chat": OP9_SQL, "op11_divergence": OP11_SQL, "op12_collocations": OP12_SQL}
