"""Name -> query over the driver's tables, and the SQL that gives the same rows where SQL can."""

from presswork.llm.decontaminate import op6_decontaminate
from presswork.llm.importance import op13_importance
from presswork.llm.language_id import op7_language_id
from presswork.llm.line_dedup import OP8_SQL, op8_line_dedup
from presswork.llm.mixing import mixing_sql, op10_mixing
from presswork.llm.near_dedup import OP4_SQL, op4_near_dedup
from presswork.llm.secret_scan import op12_secret_scan, secret_sql
from presswork.llm.sharding import op9_sharding, sharding_sql
from presswork.llm.suffix_dedup import OP1_SQL, op1_suffix_dedup
from presswork.llm.toxicity import op5_toxicity
from presswork.llm.url_reputation import OP3_SQL, op3_url_filter
from presswork.llm.vector_search import op2_vector_search
from presswork.llm.whitening import op11_whitening

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_vector_search": op2_vector_search,
    "op3_url_filter": op3_url_filter,
    "op4_near_dedup": op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_secret_scan": op12_secret_scan,
    "op13_importance": op13_importance,
}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1_SQL,
    "op3_url_filter": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_sharding": sharding_sql(64),
    "op10_mixing": mixing_sql(["source", "lang", "topic"]),
    "op12_secret_scan": secret_sql(),
}
