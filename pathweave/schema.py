"""Schemas of the graph document and of the authoring tables, with their constraints."""

from __future__ import annotations

# Field names and enumerations of the formats.
MANIFEST = "struct<generatedUtc:string,builderGitRev:string,inputs:map<string,string>,graphHash:string,counts:struct<buildings:int,routableBuildings:int,nodes:int,entrances:int,provisionalEntrances:int,crossings:int,edges:int,totalLengthM:double,components:int>>"
BUILDING = "struct<kind:string,id:string,code:string,officialName:string,displayName:string,category:string,centroid:array<double>,footprintId:string,footprintSource:string,entranceIds:array<string>,gsf:bigint,address:string,imageUrl:string,inServiceArea:boolean,routable:boolean,unroutableReason:string>"
NODE = "struct<kind:string,id:string,type:string,position:array<double>,label:string,buildingId:string,provisional:boolean,weak:boolean,entranceName:string,signalized:boolean,crossingKind:string>"
EDGE = "struct<kind:string,id:string,type:string,fromNodeId:string,toNodeId:string,geometry:array<array<double>>,lengthM:double,name:string,surface:string,stairs:boolean,stepCount:int,covered:boolean,indoor:boolean,accessible:boolean,shadeIndex:double,shadeSource:string,synthetic:boolean,osmWayId:bigint>"
GRAPH = f"manifest {MANIFEST}, buildings array<{BUILDING}>, nodes array<{NODE}>, edges array<{EDGE}>"

OVERPASS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"
REGISTER_POINTS = "features array<struct<attributes:struct<BLDG_CODE:string,BLDG_NAME:string,BLDG_NUMBER:string,BLDG_CAMPUS_CODE:string,BLDG_ADDRESS:string,BLDG_GSF:bigint,BLDG_HEIGHT_FT:int,BLDG_MAP_NUMBER:string,ExtractDateTime:bigint,EditDate:bigint>,geometry:struct<x:double,y:double>>>, exceededTransferLimit boolean"
REGISTER_SHAPES = "features array<struct<attributes:struct<BLDG_CODE:string,BLDG_NAME:string,BLDG_NUMBER:string,BLDG_ADDRESS:string,Type:string,Description:string,map_name:string,Image:string,Shape__Area:double,Shape__Length:double>,geometry:struct<rings:array<array<array<double>>>>>>, exceededTransferLimit boolean"

CATEGORIES = ("academic", "administrative", "athletics", "fine-arts", "housing", "library", "research", "student-services", "parking", "support", "unknown")
FOOTPRINT_SOURCES = ("ufrm", "campus", "proxy", "none")
NODE_TYPES = ("walkway", "entrance", "crossing")
EDGE_TYPES = ("path", "steps", "crossing", "link", "plaza", "indoor")
SURFACES = ("paved", "concrete", "asphalt", "gravel", "grass", "sand", "unknown")
SHADE_SOURCES = ("survey", "covered", "treerow", "adjacency", "default")
CROSSING_KINDS = ("traffic_signals", "marked", "unmarked")
OVERLAY_KINDS = ("entrance", "edge_attr", "name", "closure", "geometry")
RESOLUTIONS = ("exact", "spatial", "ambiguous", "failed")
ID_PATTERNS = {"building": r"^bldg:[A-Z0-9]+(#[0-9]+)?$", "node": r"^node:[a-z2-7]{8,16}$", "edge": r"^edge:[a-z2-7]{8,16}$"}
LON_BOUNDS, LAT_BOUNDS = (-112.2, -111.7), (33.3, 33.5)

_LINE = "array<struct<lon:double,lat:double>>"
_POINT = "struct<lon:double,lat:double>"
TABLES = {
    "source_feature": "source_feature_id bigint, source string, upstream_id string, raw_json string, kept boolean, reject_reason string, fetched_utc string",
    "build": "build_hash string, generated_utc string, git_rev string, builder_ver string",
    "build_input": "build_hash string, path string, sha256 string, bytes bigint",
    "build_metric": "build_hash string, metric string, value double, gate string, passed boolean",
    "building": f"building_id string, code string, ordinal int, official_name string, display_name string, category string, footprint_id bigint, footprint_src string, gsf bigint, address string, image_url string, in_service_area boolean, routable boolean, unroutable_why string, centroid {_POINT}",
    "building_alias": "building_id string, alias string, alias_norm string, source string",
    "footprint": f"footprint_id bigint, code string, area_m2 double, geom {_LINE}",
    "node": f"node_id string, idx int, type string, label string, osm_node_id bigint, building_id string, provisional boolean, weak boolean, entrance_nm string, signalized boolean, cross_kind string, geom {_POINT}",
    "edge": f"edge_id string, idx int, from_node_id string, to_node_id string, ord int, type string, name string, length_m double, surface string, stairs boolean, step_count int, covered boolean, indoor boolean, tunnel boolean, bridge boolean, layer int, accessible boolean, shade_index double, shade_source string, synthetic boolean, osm_way_id bigint, geom {_LINE}",
    "entrance": "node_id string, building_id string, ordinal int, snap_m double, side string",
    "overlay_ref": "overlay_id string, file string, kind string, ref_primary string, ref_fallback string, payload_json string, resolved_to string, resolution string, authored_by string, authored_utc string, note string",
    "closure": "closure_id string, reason string, from_utc timestamp, to_utc timestamp, source_url string",
    "closure_edge": "closure_id string, edge_id string",
    "route_sample": "build_hash string, from_bldg string, to_bldg string, graph_m double, straight_m double, detour_ratio double, hops int, failure string",
}


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


#: Table -> {constraint: SQL condition}; a row breaks one whose condition is false (null passes).
CHECKS = {
    "source_feature": {"reason": "kept = (reject_reason IS NULL)", "present": "source IS NOT NULL AND upstream_id IS NOT NULL AND kept IS NOT NULL"},
    "build": {"hash": "length(build_hash) BETWEEN 16 AND 64"},
    "build_input": {"sha256": "length(sha256) = 64"},
    "building": {
        "ordinal": "ordinal >= 0", "category": _one_of("category", CATEGORIES), "footprint_src": _one_of("footprint_src", FOOTPRINT_SOURCES),
        "gsf": "gsf >= 0", "why": "routable = (unroutable_why IS NULL)",
    },
    "node": {
        "type": _one_of("type", NODE_TYPES), "entrance": "type <> 'entrance' OR (building_id IS NOT NULL AND provisional IS NOT NULL)",
        "crossing": "type <> 'crossing' OR signalized IS NOT NULL", "building": "type = 'entrance' OR building_id IS NULL", "cross_kind": _one_of("cross_kind", CROSSING_KINDS),
    },
    "edge": {
        "order": "from_node_id < to_node_id", "length": "length_m > 0 AND length_m < 2000", "shade_index": "shade_index BETWEEN 0 AND 1", "type": _one_of("type", EDGE_TYPES),
        "surface": _one_of("surface", SURFACES), "shade_source": _one_of("shade_source", SHADE_SOURCES), "step_count": "step_count > 0", "steps": "stairs OR step_count IS NULL",
    },
    "entrance": {"ordinal": "ordinal >= 0", "snap": "snap_m >= 0 AND snap_m <= 120"},
    "overlay_ref": {"kind": _one_of("kind", OVERLAY_KINDS), "resolution": _one_of("resolution", RESOLUTIONS), "resolved": "(resolution IN ('exact', 'spatial')) = (resolved_to IS NOT NULL)"},
    "closure": {"interval": "to_utc > from_utc"},
    "route_sample": {"outcome": "(graph_m IS NULL) <> (failure IS NULL)"},
}
KEYS = {
    "source_feature": [("source_feature_id",), ("source", "upstream_id")], "build": [("build_hash",)], "build_input": [("build_hash", "path")], "build_metric": [("build_hash", "metric")],
    "building": [("building_id",), ("code", "ordinal")], "building_alias": [("building_id", "alias_norm")], "footprint": [("footprint_id",)], "node": [("node_id",), ("idx",)],
    "edge": [("edge_id",), ("idx",), ("from_node_id", "to_node_id", "ord")], "entrance": [("node_id",), ("building_id", "ordinal")], "overlay_ref": [("overlay_id",)],
    "closure": [("closure_id",)], "closure_edge": [("closure_id", "edge_id")], "route_sample": [("build_hash", "from_bldg", "to_bldg")],
}
#: (table, column, table it refers to, column there)
REFERENCES = [
    ("build_input", "build_hash", "build", "build_hash"), ("build_metric", "build_hash", "build", "build_hash"), ("route_sample", "build_hash", "build", "build_hash"),
    ("building", "footprint_id", "footprint", "footprint_id"), ("building_alias", "building_id", "building", "building_id"), ("node", "building_id", "building", "building_id"),
    ("edge", "from_node_id", "node", "node_id"), ("edge", "to_node_id", "node", "node_id"), ("entrance", "node_id", "node", "node_id"), ("entrance", "building_id", "building", "building_id"),
    ("closure_edge", "closure_id", "closure", "closure_id"), ("closure_edge", "edge_id", "edge", "edge_id"),
]
