"""Table layouts of the engine. Vectors are long tables (row_id, col_id, value); ids of -1 are kept at the edges only."""

from __future__ import annotations

RAW_PAGE = "lang_id short, page_id int, revision_id int, body string, title string, last_edit timestamp, name_space short, is_redirect boolean, is_disambig boolean, redirect_title string"
LOCAL_PAGE = "lang_id short, page_id int, title string, name_space short, is_redirect boolean, is_disambig boolean"
LOCAL_LINK = "lang_id short, anchor_text string, source_id int, dest_id int, location int, is_parseable boolean, location_type short"
REDIRECT = "lang_id short, src_page_id int, dest_page_id int"
CATEGORY_MEMBER = "lang_id short, category_id int, article_id int"
INTER_LANGUAGE_LINK = "source_lang short, source_id int, dest_lang short, dest_id int"
UNIVERSAL_PAGE = "lang_id short, page_id int, name_space short, univ_id int, algorithm_id int"
UNIVERSAL_LINK = "lang_id short, local_source_id int, local_dest_id int, univ_source_id int, univ_dest_id int, algorithm_id int"
SKELETAL_LINK = "source_id int, dest_id int, algorithm_id int, langs array<short>"
LOAD_COUNT = "component string, lang_id short, num_records int, num_errors int, last_updated timestamp"
PAGE_VIEW = "lang_id short, page_id int, tstamp timestamp, num_views int"
ENTITY_LABEL = "entity_type string, entity_id int, lang_id short, label string"
STATEMENT = "id string, entity_type string, entity_id int, prop_id int, val_type string, val_str string, rank short"
GEOMETRY = "item_id int, layer string, ref_sys string, lon double, lat double"
VECTOR = "row_id long, col_id long, value double"
DENSE = "id long, embedding array<float>"
GOLD = "dataset string, phrase1 string, phrase2 string, similarity double"

ARTICLE, TALK, CATEGORY = 0, 1, 14
FIRST_PARA, FIRST_SEC, NO_LOCATION = 0, 1, 2
NAMESPACES = {
    "special": -1, "media": -2, "": 0, "article": 0, "main": 0, "talk": 1, "user": 2, "user talk": 3, "project": 4, "project talk": 5, "file": 6, "image": 6,
    "file talk": 7, "mediawiki": 8, "mediawiki talk": 9, "template": 10, "template talk": 11, "help": 12, "help talk": 13, "category": 14, "category talk": 15,
    "portal": 100, "portal talk": 101,
}
