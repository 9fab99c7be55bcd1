"""Row types of the engine."""

#: A document or part to be read: bytes with their type.
SOURCE = "doc_id string, content binary, media_type string, name string"
#: A piece of HTML text; ``chunk_seq`` orders the pieces of a part, and ``is_last`` ends them.
CHUNK = "doc_id string, part_index int, chunk_seq long, delta string, is_last boolean"
BLOCK = "struct<id:string,html:string>"
#: An input of the document fold; ``type`` says which of the nullable fields count.
EVENT = "doc_id string, pos long, type string, id string, html string, phase string, message string"
#: A numbered event of the replayable log.
LIVE_EVENT = "doc_id string, version int, seq long, type string, block_id string, target string, html string, phase string, message string"
ELEMENT = "struct<label:string,bbox:array<int>,page:int,content:string>"
STATE = f"doc_id string, seq long, status string, phase string, blocks array<{BLOCK}>"

#: The engine's own version of the event contract.
VERSION = 1
EOF_TYPES = ("done", "error")
