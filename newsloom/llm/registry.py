"""All queries of this subpackage and their SQL."""

from newsloom.llm import q_decontam, q_kneser_ney, q_langid, q_line_rules, q_minhash, q_packing, q_parity_join, q_repeats, q_url_filter, q_vectors, q_warc

MODULES = [q_minhash, q_repeats, q_kneser_ney, q_line_rules, q_langid, q_url_filter, q_packing, q_decontam, q_warc, q_vectors, q_parity_join]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQLS = {name: s for m in MODULES for name, s in m.SQLS.items()}
