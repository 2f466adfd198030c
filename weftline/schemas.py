"""Schemas of the catalog tables."""

PAIR = "struct<name:string,value:string>"
PARAMETER = "struct<name:string,description:string>"
#: How a collection is paged (see sources/rest.py); null where its description declares no parameter for it.
PAGING = "struct<kind:string,page:string,size:string>"
#: honoursKeys: the description declares an Idempotency-Key header.
ENDPOINT = f"struct<name:string,description:string,path:string,method:string,parameters:array<{PARAMETER}>,requestBody:string,responseSchema:string,paging:{PAGING},honoursKeys:boolean>"
SCHEMA = "struct<name:string,description:string,fields:array<struct<name:string,description:string>>>"
PART = f"struct<api:string,getAll:{ENDPOINT},getOne:{ENDPOINT},create:{ENDPOINT},update:{ENDPOINT},delete:{ENDPOINT},fieldMapping:map<string,string>>"

APIS = f"id string, name string, baseUrl string, accessToken string, parameterSubstitutions array<{PAIR}>, endpoints array<{ENDPOINT}>, schemas array<{SCHEMA}>"
MAPPINGS = f"id string, name string, parts array<{PART}>"
#: The id map is a log: the last row of a pair's source id counts.
ID_MAP = "mapping_id string, a_id string, b_id string, seq long"

#: What each directed pass did. recovered: rows of a pass that had been cut off, sent or committed later.
PASSES = "run_id string, mapping_id string, reverse boolean, n_read long, n_created long, n_updated long, n_unchanged long, n_failed long, n_in_doubt long, recovered boolean"
#: Creates of which nobody knows whether they were done; the last row of a key counts, until it is settled.
IN_DOUBT = "mapping_id string, reverse boolean, source_id string, url string, body string, key string, run_id string, seq long, settled boolean"

#: What was last sent to each target of a direction, and over which base.
SENT = "mapping_id string, reverse boolean, target_id string, payload_digest string, base_digest string, seq long"
