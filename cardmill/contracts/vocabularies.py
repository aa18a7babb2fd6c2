"""Value lists of the contracts. All of them are fixed values."""

# Two-letter content codes and their long names.
CONTENT_CODES = {
    "AI": "Artificial Intelligence",
    "BR": "Breast Imaging",
    "BQ": "Biomarkers/Quantitative Imaging",
    "CA": "Cardiac Imaging",
    "CH": "Chest Imaging",
    "CT": "Computed Tomography",
    "DM": "Dose Management",
    "ED": "Education",
    "ER": "Emergency Radiology",
    "GI": "Gastrointestinal Imaging",
    "GU": "Genitourinary Imaging",
    "HN": "Head and Neck Imaging",
    "HP": "Health Policy",
    "IN": "Informatics",
    "IR": "Interventional Radiology",
    "LM": "Laboratory Medicine",
    "MI": "Molecular Imaging",
    "MK": "Musculoskeletal Imaging",
    "MR": "Magnetic Resonance",
    "NM": "Nuclear Medicine",
    "NR": "Neuroradiology",
    "OB": "Obstetric and Gynecologic Imaging",
    "OI": "Oncological Imaging",
    "OT": "Outcomes Research",
    "PD": "Pediatric Imaging",
    "PH": "Physics",
    "PR": "Practice Management",
    "SQ": "Safety and Quality",
    "RO": "Radiation Oncology",
    "RS": "Radiological Sciences",
    "US": "Ultrasound",
    "VA": "Vascular and Interventional Imaging",
}

# Imaging modalities of the declared contract.
MODALITIES = (
    "3-Dimensional ultrasound (RID10920)",
    "4-Dimensional CT (RID38755)",
    "4-Dimensional ultrasound (RID10926)",
    "A-mode ultrasound (RID10903)",
    "B-mode ultrasound (RID10904)",
    "Bremsstrahlung imaging (RID10336)",
    "C-mode ultrasound (RID10907)",
    "Color doppler mode (RID10909)",
    "Combined modalities (RID49580)",
    "Computed radiography (RID10349)",
    "Computed tomography (RID10321)",
    "Conventional tomography (RID10358)",
    "Diffusion tensor imaging (RID38778)",
    "Digital radiography (RID10351)",
    "Doppler mode (RID10908)",
    "Dual energy xray absorptiometry (RID10363)",
    "Dual-energy CT (RID38660)",
    "Dual-energy subtraction radiography (RID10356)",
    "Duplex ultrasound (RID10922)",
    "Dynamic contrast-enhanced magnetic resonance imaging (RID49531)",
    "Elastography (RID10932)",
    "Extended field-of-view ultrasound (RID10924)",
    "Fluoroscopy (RID10361)",
    "Functional magnetic resonance imaging (RID10317)",
    "Harmonic ultrasound (RID10913)",
    "High intensity pulse (RID10919)",
    "High-energy scan (RID12412)",
    "Low intensity pulse (RID10918)",
    "Low-energy scan (RID12411)",
    "MR fluoroscopy (RID11071)",
    "Magnetic resonance angiography (RID10319)",
    "Magnetic resonance imaging (RID10312)",
    "Magnetic resonance spectroscopy (RID10315)",
    "Mammography (RID10357)",
    "Molecular imaging (RID12508)",
    "Nuclear medicine imaging (RID10330)",
    "Other modality (dicom) (RID49585)",
    "PET-CT (RID10341)",
    "PET-MR (RID10342)",
    "Panographic radiograph (RID10360)",
    "Phase-cancellation harmonic ultrasound (RID10914)",
    "Planar nuclear medicine imaging (RID10333)",
    "Positron emission tomography (RID10337)",
    "Power doppler mode (RID10910)",
    "Projection radiography (RID10345)",
    "Quantitative computed tomography (RID10323)",
    "Radiofluoroscopy (RID45709)",
    "SPECT-CT (RID49583)",
    "Scintigraphy (RID34428)",
    "Screen-film radiography (RID10353)",
    "Single photon emission computed tomography (RID10334)",
    "Single photon imaging (RID10332)",
    "Spectral doppler mode (RID10911)",
    "Spectroscopy (RID10377)",
    "Stereoscopy (RID50131)",
    "Stereotactic radiography (RID50260)",
    "Stimulated acoustic emission (RID10916)",
    "Strain imaging (RID10933)",
    "Tomography (RID28840)",
    "Tomosynthesis (RID10359)",
    "Triplex ultrasound (RID10923)",
    "US-RF (RID49581)",
    "Ultrasound (RID10326)",
    "Volume imaging (RID10930)",
    "XR-RF (RID49582)",
)

# The short lists of the declared contract.
DATA_TYPES = ("Report text", "Image", "Medical record data", "Photograph", "Graph")
SAMPLE_TYPES = (
    "Complete population",
    "Random sample",
    "Convenience sample",
    "Non-random sample",
    "Other",
)
FILE_FORMATS = ("DICOM", "JPEG", "NiFTI", "PNG", "Other")
BURNED_IN = ("Yes", "No", "Unknown")
AGE_UNITS = ("days", "months", "years")
SEXES = ("Female", "Male", "Unknown", "Not specified")
DEMOGRAPHICS = (
    "American Indian or Alaska Native",
    "Asian",
    "Black or African American",
    "Hispanic or Latino",
    "Middle Eastern or North African",
    "Native Hawaiian or Pacific Islander",
    "White",
)

# The lists of the older contracts.
LEGACY_CODES = tuple(f"{code} - {name}" for code, name in CONTENT_CODES.items())
LEGACY_USES = (
    "Detection",
    "Diagnosis",
    "Prognosis",
    "Risk assessment",
    "Decision support",
    "Image processing",
    "Image segmentation",
    "Image reconstruction",
    "Report generation",
    "Screening",
    "Monitoring",
    "Treatment planning",
    "Quality assurance",
    "Research",
    "Other",
)
LEGACY_USERS = (
    "Radiologist",
    "Diagnostic radiologist",
    "Interventional radiologist",
    "Subspecialist diagnostic radiologist",
    "Physician",
    "Referring physician",
    "Advanced practice provider",
    "Nurse practitioner",
    "Physician assistant",
    "Radiology technologist",
    "Researcher",
    "Data scientist",
    "Other healthcare provider",
)
LEGACY_METRICS = (
    "Accuracy",
    "Sensitivity",
    "Specificity",
    "Precision",
    "Recall",
    "F1 score",
    "AUC-ROC",
    "AUC-PR",
    "Dice similarity coefficient",
    "Intersection over Union",
    "Mean absolute error",
    "Root mean square error",
    "Other",
)
LEGACY_DATA_TYPES = (
    "Image",
    "Report text",
    "Medical record data",
    "Photograph",
    "Graph",
    "Other",
)
LEGACY_MODALITIES = (
    "Computed tomography (CT)",
    "Magnetic resonance imaging (MRI)",
    "X-ray/Radiography",
    "Ultrasound",
    "Mammography",
    "Nuclear medicine",
    "PET-CT",
    "PET-MR",
    "Other",
)
