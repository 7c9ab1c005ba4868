"""The subpackage's queries and the SQL of those that SQL can express."""

from . import chat, divergence, fim, licenses, line_dedup
from .chat import op7_chat_format
from .decontaminate import op5_decontaminate
from .divergence import op12_source_divergence
from .extract import op10_html_extract
from .fim import op13_fill_in_middle
from .fingerprint import op4_fingerprint
from .language import op2_language_id
from .licenses import op3_license_scan
from .line_dedup import op6_line_dedup
from .lm import op11_lm_score
from .mixing import op9_mixing
from .near_dedup import op8_near_dedup
from .toxicity import op1_toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_language_id, op3_license_scan, op4_fingerprint, op5_decontaminate, op6_line_dedup, op7_chat_format, op8_near_dedup, op9_mixing, op10_html_extract, op11_lm_score, op12_source_divergence, op13_fill_in_middle, pipeline)
}
ORACLE_SQL = {"op3_license_scan": licenses.oracle(), "op6_line_dedup": line_dedup.ORACLE, "op7_chat_format": chat.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_fill_in_middle": fim.ORACLE}
