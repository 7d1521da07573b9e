"""The shipped funder dictionary (public-domain data)."""

from __future__ import annotations

#: Canonical name, country, parent funder, further variants.
FUNDERS: tuple[tuple[str, str, str | None, tuple[str, ...]], ...] = (
    ("National Natural Science Foundation of China", "China", None, ("National Natural Science Foundation", "NSFC", "grants from the National Natural Science Foundation", "NNSFC", "Natural Science Foundation of China")),
    ("National Institutes of Health", "USA", None, ("NIH",)),
    ("National Science Foundation", "USA", None, ("NSF", "US National Science Foundation")),
    ("European Research Council", "EU", "European Commission", ("ERC",)),
    ("Medical Research Council", "UK", "UK Research and Innovation", ("MRC", "UK Medical Research Council")),
    ("Japan Society for the Promotion of Science", "Japan", None, ("Japan Society", "JSPS")),
    ("Deutsche Forschungsgemeinschaft", "Germany", None, ("DFG", "German Research Foundation")),
    ("Wellcome Trust", "UK", None, ("a Wellcome Trust", "Wellcome")),
    ("National Research Foundation of Korea", "Korea", None, ("National Research Foundation", "NRF", "Korea National Research Foundation")),
    ("Biotechnology and Biological Sciences Research Council", "UK", "UK Research and Innovation", ("Biological Sciences Research Council", "BBSRC")),
    ("Agence Nationale de la Recherche", "France", None, ("ANR", "French National Research Agency")),
    ("European Regional Development Fund", "EU", None, ("FEDER", "ERDF")),
    ("National Cancer Institute", "USA", "National Institutes of Health", ("NCI",)),
    ("Engineering and Physical Sciences Research Council", "UK", "UK Research and Innovation", ("Engineering Research Council", "EPSRC")),
    ("Swiss National Science Foundation", "Switzerland", None, ("SNF", "SNSF")),
    ("National Institute of Allergy and Infectious Diseases", "USA", "National Institutes of Health", ("NIAID",)),
    ("United States Department of Agriculture", "USA", None, ("USDA",)),
    ("Ministerio de Economia y Competitividad", "Spain", None, ("Spanish Ministry", "MINECO")),
    ("Japan Agency for Medical Research and Development", "Japan", None, ("Japan Agency", "AMED")),
    ("Austrian Science Fund", "Austria", None, ("FWF",)),
    ("Bundesministerium fur Bildung und Forschung", "Germany", None, ("BMBF", "German Federal Ministry")),
    ("National Institute for Health Research", "UK", None, ("NIHR",)),
    ("Swedish Research Council", "Sweden", None, ("VR", "Vetenskapsradet")),
    ("Howard Hughes Medical Institute", "USA", None, ("HHMI",)),
    ("Australian Research Council", "Australia", None, ("ARC",)),
    ("National Institute of General Medical Sciences", "USA", "National Institutes of Health", ("NIGMS",)),
    ("Ministry of Education, Culture, Sports, Science and Technology", "Japan", None, ("MEXT",)),
    ("Natural Sciences and Engineering Research Council of Canada", "Canada", None, ("NSERC",)),
    ("Department of Energy", "USA", None, ("DOE",)),
    ("Fundacao para a Ciencia e a Tecnologia", "Portugal", None, ("FCT",)),
    ("Coordenacao de Aperfeicoamento de Pessoal de Nivel Superior", "Brazil", None, ("CAPES",)),
    ("European Commission", "EU", None, ("EC", "EU", "European Union")),
    ("Fundacao de Amparo a Pesquisa do Estado de Sao Paulo", "Brazil", None, ("FAPESP", "Sao Paulo Research Foundation")),
    ("Bill and Melinda Gates Foundation", "USA", None, ("Melinda Gates Foundation", "BMGF", "Gates Foundation")),
    ("National Health and Medical Research Council", "Australia", None, ("NHMRC",)),
    ("Italian Ministry", "Italy", None, ()),
    ("China Postdoctoral Science Foundation", "China", None, ()),
    ("National Human Genome Research Institute", "USA", "National Institutes of Health", ("NHGRI",)),
    ("China Scholarship Council", "China", None, ("CSC",)),
    ("Ministry of Science and Technology", "Taiwan", None, ("MOST",)),
    ("Netherlands Organisation for Scientific Research", "Netherlands", None, ("NWO", "Dutch Research Council")),
    ("Russian Science Foundation", "Russia", None, ("RSF",)),
    ("Royal Society", "UK", None, ()),
    ("Canadian Institutes of Health Research", "Canada", None, ("CIHR",)),
    ("Natural Environment Research Council", "UK", "UK Research and Innovation", ("NERC",)),
    ("National Heart Lung and Blood Institute", "USA", "National Institutes of Health", ("NHLBI", "Blood Institute")),
    ("Centre National de la Recherche Scientifique", "France", None, ("CNRS",)),
    ("Research Foundation Flanders", "Belgium", None, ("FWO",)),
    ("National Key Research and Development Program", "China", None, ()),
    ("National Science Centre", "Poland", None, ("NCN",)),
    ("American Heart Association", "USA", None, ("AHA",)),
    ("Department of Biotechnology", "India", None, ("DBT",)),
    ("Japan Science and Technology Agency", "Japan", None, ("JST",)),
    ("Max Planck Society", "Germany", None, ("Max Planck", "MPG")),
    ("Czech Science Foundation", "Czech Republic", None, ("GACR",)),
    ("UK Research and Innovation", "UK", None, ("UKRI",)),
    ("Associazione Italiana per la Ricerca sul Cancro", "Italy", None, ("AIRC",)),
)
