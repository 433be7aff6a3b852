"""Schemas at the edges: documents, chunks, evidence, relations."""

MENTION = "struct<id:string,trigger_word:string,text:string,name:string,sent_id:int,sentence_id:int,token_id:int,offset:array<int>>"
ENTITIES = f"map<string,struct<type:string,lemma:string,mentions:array<{MENTION}>>>"
RELATIONS = "map<string,array<array<string>>>"
DOCUMENT = f"document_id string, id string, title string, text string, type string, sentences array<string>, tokens array<array<string>>, entities {ENTITIES}, relations {RELATIONS}, pred_relations {RELATIONS}"
NORMALISED = ("document_id", "title", "text", "type", "sentences", "tokens", "entities", "relations")
CORRUPT = "_corrupt"
