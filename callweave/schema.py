"""Explicit schemas of the entities; every field is nullable and nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


UTTERANCE = _struct(speaker=S, utterance=S)
SENTIMENT = _struct(score=D, label=S)
TURN = _struct(conversation=T.ArrayType(UTTERANCE), sentiment=SENTIMENT)

PREDEFINED_DRIVER = _struct(driver=S, dialogue_pair_index=L, sentiment=D)
IDENTIFIED_DRIVER = _struct(keyword=S, definition=S, dialogue_pair_index=L, sentiment=D)
PAIR_INTENTS = _struct(dialogue_pair_index=L, intents=T.ArrayType(S))

METADATA = _struct(
    completed_fields=_struct(domain=S, intent=S, reason_for_the_call=S),
    call_summary=S,
    outcome=S,
    predefined_interaction_drivers=T.ArrayType(PREDEFINED_DRIVER),
    identified_interaction_drivers=T.ArrayType(IDENTIFIED_DRIVER),
    dialogue_pair_intents=T.ArrayType(PAIR_INTENTS),
)

#: A call as stored, plus the flat shape in which raw calls may also arrive.
CALL = _struct(
    transcript_id=S,
    id=S,
    filename=S,
    timestamp=T.TimestampType(),
    domain=S,
    intent=S,
    reason_for_call=S,
    turns=T.ArrayType(TURN),
    sentiment=SENTIMENT,
    dialogue=T.ArrayType(_struct(speaker=S, text=S)),
    metadata=METADATA,
)

CLUSTER = _struct(
    type=S,
    field=S,
    id=S,
    name=S,
    description=S,
    embedding=T.ArrayType(D),
    child_count=L,
    parent_id=S,
    member_ids=T.ArrayType(S),
)

CHAT = _struct(id=S, title=S, created_at=T.TimestampType(), updated_at=T.TimestampType())
MESSAGE = _struct(
    id=S, chat_id=S, role=S, content=S, model=S, token_count=T.IntegerType(),
    metadata=S, created_at=T.TimestampType(),
)

EVALUATION = _struct(
    query_idx=L, Query=S, Expected_Answer=S, Ground_Truth=S, Retrieved_Calls=S, Final_Answer=S
)
