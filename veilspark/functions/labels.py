"""Entity types, short names, labels and word lists, as plain text."""

#: Entity types found by their shape.
PATTERN_ENTITIES = ("PERSON", "LOCATION", "PHONE_NUMBER", "EMAIL_ADDRESS", "US_SSN", "MEDICAL_LICENSE", "US_DRIVER_LICENSE", "URL", "IP_ADDRESS", "US_PASSPORT", "US_ITIN", "US_BANK_NUMBER", "CREDIT_CARD", "IBAN_CODE", "CRYPTO")
#: Entity types found by labels nearby or by geometry.
CONTEXT_ENTITIES = ("GENERIC_ID", "MEDICAL_RECORD_NUMBER", "ACCOUNT_NUMBER", "HEALTH_PLAN_ID", "CLAIM_NUMBER", "DATE", "AGE", "FACE", "SIGNATURE")
SHORT_NAMES = {
    "PERSON": "NAME", "LOCATION": "ADDR", "MEDICAL_RECORD_NUMBER": "MRN", "ACCOUNT_NUMBER": "ACCT", "HEALTH_PLAN_ID": "PLAN", "CLAIM_NUMBER": "CLAIM",
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "US_SSN": "SSN", "US_DRIVER_LICENSE": "DL", "US_PASSPORT": "PPT", "MEDICAL_LICENSE": "LIC",
    "US_BANK_NUMBER": "BANK", "CREDIT_CARD": "CARD", "IP_ADDRESS": "IP", "US_ITIN": "ITIN", "IBAN_CODE": "IBAN", "AGE": "AGE", "FACE": "FACE",
    "SIGNATURE": "SIG", "ORGANIZATION": "ORG", "GENERIC_ID": "ID",
}
#: Labels of identifiers; their order decides ties.
ID_LABELS = {
    "GENERIC_ID": ("unique id", "identifier", "employee id", "customer id", "client id", "user id", "record id", "case id", "reference id", "document id", "order id", "transaction id", "ticket id", "asset id", "hospital id", "doctor id"),
    "MEDICAL_RECORD_NUMBER": ("mrn", "med rec", "medical record", "medical rec", "med record"),
    "ACCOUNT_NUMBER": ("account", "acct", "patient account", "patient control", "pat cntl"),
    "HEALTH_PLAN_ID": ("health plan id", "member id", "insured's unique id", "insureds unique id", "subscriber id", "subscriber number", "policy id", "policy number", "group id", "group number", "patient id", "certificate"),
    "CLAIM_NUMBER": ("claim number", "claim no", "claim #", "claim id"),
}
PERSON_LABELS = ("name", "full name", "customer", "customer name", "employee name", "contact name", "recipient name", "applicant name", "account holder", "patient name")
PROVIDER_LABELS = ("attending", "operating", "referring", "rendering", "other", "npi", "physician", "provider", "surgeon", "added by", "counselor", "qual", "ordering", "admitting", "signature", "signed by", "taxonomy", "taxpayer", "payee", "clearing house", "clearinghouse", "facility")
FACILITY_NOUNS = ("hospital", "clinic", "institute", "laboratory", "labs", "pharmacy", "physicians", "center", "centre", "healthcare", "medical", "health")
UI_NOISE = ("select", "filter", "export", "update", "none", "total", "balance")
TOO_COMMON = tuple("account address amount balance code date description document email name number page phone record status total type value work home other none general po box apt suite unit floor mail llc inc corp company ltd group id customer client employee recipient applicant holder case support".split())
STREET_SUFFIXES = tuple("ST STREET DR DRIVE RD ROAD LN LANE CT COURT AVE AVENUE BLVD BOULEVARD WAY PL PLACE TER TERRACE TRL PKWY PARKWAY CIR CIRCLE HWY HIGHWAY RIDGE GLEN RUN ARCADE PLAZA SQUARE QUAY WALK ROW".split())
US_STATES = tuple("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR".split())
TOLL_FREE = ("800", "833", "844", "855", "866", "877", "888")
#: Labels that prove a name to be the patient's, and of organizations and their addresses, where professionals are kept.
PATIENT_LABELS = ("patient name", "pat name", "patient's name", "guarantor", "insured's name", "insureds name", "subscriber name", "bill to", "responsible party")
FACILITY_LABELS = ("medical center", "hospital", "clinic", "insurance", "health plan", "healthcare", "health system", "laboratory", "pharmacy", "payer", "street", "avenue", "ave", "blvd", "road", "drive", "suite")
#: Entities of which a value beside a professional's label is kept, where professionals are kept.
PROVIDER_SUPPRESSIBLE = ("PERSON", "PHONE_NUMBER", "US_BANK_NUMBER", "US_ITIN", "US_PASSPORT", "MEDICAL_LICENSE", "US_DRIVER_LICENSE", "IBAN_CODE")
#: Entities whose values are too generic to look for elsewhere.
NOT_PROPAGATED = ("DATE", "AGE", "LOCATION", "FACE", "SIGNATURE")
#: Free text types to entities, for fields that a model or a form names.
ALIASES = {
    "date": "DATE", "date of birth": "DATE", "dob": "DATE", "birthdate": "DATE",
    "person": "PERSON", "name": "PERSON", "full name": "PERSON", "employee name": "PERSON", "customer name": "PERSON",
    "address": "LOCATION", "city": "LOCATION", "state": "LOCATION", "zip": "LOCATION", "zip code": "LOCATION", "postal code": "LOCATION", "location": "LOCATION",
    "ssn": "US_SSN", "social security number": "US_SSN", "phone": "PHONE_NUMBER", "phone number": "PHONE_NUMBER", "telephone": "PHONE_NUMBER", "fax": "PHONE_NUMBER",
    "email": "EMAIL_ADDRESS", "email address": "EMAIL_ADDRESS",
    "record id": "GENERIC_ID", "record number": "GENERIC_ID", "employee id": "GENERIC_ID", "customer id": "GENERIC_ID", "user id": "GENERIC_ID", "reference id": "GENERIC_ID", "identifier": "GENERIC_ID", "identification": "GENERIC_ID", "id number": "GENERIC_ID",
    "account": "ACCOUNT_NUMBER", "account number": "ACCOUNT_NUMBER",
}
