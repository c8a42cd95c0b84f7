"""Declared schemas of every source; nothing is inferred."""

from __future__ import annotations

GENE = "gene STRUCT<entrezGeneId: INT, hugoGeneSymbol: STRING, type: STRING>"

VARIANT = (
    f"uniqueSampleKey STRING, uniquePatientKey STRING, molecularProfileId STRING, sampleId STRING, patientId STRING, "
    f"entrezGeneId INT, {GENE}, studyId STRING, center STRING, mutationStatus STRING, validationStatus STRING, "
    "tumorAltCount INT, tumorRefCount INT, normalAltCount INT, normalRefCount INT, startPosition LONG, "
    "endPosition LONG, referenceAllele STRING, proteinChange STRING, mutationType STRING, ncbiBuild STRING, "
    "variantType STRING, refseqMrnaId STRING, proteinPosStart INT, proteinPosEnd INT, keyword STRING, chr STRING, "
    "variantAllele STRING, hugoGeneSymbol STRING"
)
MEASURE = "sampleId STRING, patientId STRING, entrezGeneId INT, value DOUBLE"
ATTRIBUTE = "clinicalAttributeId STRING, value STRING, patientId STRING, sampleId STRING, studyId STRING"
STUDY = "studyId STRING, name STRING, allSampleCount INT"
SUMMARY = (
    "image_file STRING, patient_id STRING, sample_id STRING, status STRING, expression DOUBLE, "
    "total_mutations INT, stage STRING"
)
SLIDE_INDEX = "file_name STRING, file_id STRING, patient STRING, sample STRING"
REMOTE_FILE = "file_id STRING, file_name STRING, md5 STRING, size LONG, state STRING"
LABELS = "slide STRING, label INT"
PREDICTIONS = "slide STRING, repeat INT, fold INT, prob DOUBLE"
TILES = "slide STRING, tile_idx INT, x INT, y INT"
EMBEDDINGS = "slide STRING, tile_idx INT, level INT, x INT, y INT, emb ARRAY<FLOAT>"
PIXELS = "slide STRING, tile_idx INT, x INT, y INT, r INT, g INT, b INT"
CASES = (
    "data STRUCT<cases: ARRAY<STRUCT<submitter_id: STRING, demographic: STRUCT<gender: STRING, vital_status: STRING>, "
    "diagnoses: ARRAY<STRUCT<ajcc_pathologic_stage: STRING, primary_diagnosis: STRING, age_at_diagnosis: INT>>, "
    "samples: ARRAY<STRUCT<sample_type: STRING, portions: ARRAY<STRUCT<portion_id: STRING>>>>>>, file_name: STRING, "
    "file_id: STRING, md5sum: STRING, file_size: LONG, state: STRING>"
)
