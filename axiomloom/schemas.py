"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

S = T.StringType()


def _rows(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TRIPLE = _rows(subject=S, predicate=S, object=S)

AXIOM_CSV = _rows(
    id=S, axiom_type=S, subject=S, predicate=S, object=S, label=S, source=S,
    negative_strategy=S, axiom_text=S, context_info=S,
)

PAIR = _rows(sub=S, super=S)
PROPERTY_PAIR = T.StructType([T.StructField("property", S), T.StructField("class", S)])
LAYER1_TRIPLE = _rows(subject=S, relation=S, predicate=S, object=S, chunk=S, context=S)

LAYER1_DOC = _rows(
    doc_id=S, domain=S, chunk_count=T.IntegerType(), terms=T.ArrayType(S),
    triples=T.ArrayType(LAYER1_TRIPLE),
)
LAYER2_DOC = _rows(
    doc_id=S, domain=S,
    normalized_terms=T.ArrayType(_rows(original=S, normalized=S, type=S)),
    term_map=T.MapType(S, S), type_map=T.MapType(S, S),
    updated_triples=T.ArrayType(_rows(
        subject=S, relation=S, object=S, evidence=T.ArrayType(_rows(chunk=S, context=S)))),
    error=S,
)
# Document form: "domain" is the domain's name, the lists carry "_axioms".
LAYER3_DOC = _rows(
    doc_id=S, domain=S, classes=T.ArrayType(S), properties=T.ArrayType(S),
    subClassOf=T.ArrayType(PAIR), subPropertyOf=T.ArrayType(PAIR),
    domain_axioms=T.ArrayType(PROPERTY_PAIR), range_axioms=T.ArrayType(PROPERTY_PAIR),
)
# Chunk form: "domain" and "range" are the lists themselves.
LAYER3_CHUNK = _rows(
    chunk_id=S, classes=T.ArrayType(S), properties=T.ArrayType(S),
    subClassOf=T.ArrayType(PAIR), subPropertyOf=T.ArrayType(PAIR),
    domain=T.ArrayType(PROPERTY_PAIR), range=T.ArrayType(PROPERTY_PAIR), error=S,
)

# One item of a results tree in any of its spellings.
RESULT_ITEM = _rows(
    method=S, domain=S, axiom_type=S, axiomType=S, type=S, subject=S, object=S, sub=S,
    super=S, subjectTerm=S, objectTerm=S, child=S, parent=S, axiom_text=S, axiomText=S,
)
