"""Parameters of the terrain engine, in metres and pixels as named."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    horizontal_scale: float = 2.0
    vertical_scale: float = 0.492
    sea_level_offset: float = 0.1
    noise_reduction_sigma: float = 1.0
    max_elevation_range: float = 10000.0
    gradient_method: str = "central_difference"
    flat_threshold_deg: float = 0.5
    adaptive_epsilon: bool = True
    curvature_epsilon: float = 1e-5
    h_factor: float = 0.25
    k_factor: float = 0.35
    h_min: float = 5e-5
    k_min: float = 2e-5
    h_max: float = 0.05
    k_max: float = 0.001
    peak_confidence: float = 20.0
    peak_min_shoulder_samples: int = 10
    min_peak_size_px: int = 1
    peak_min_prominence_m: float = 10.0
    peak_shoulder_convex_ratio: float = 0.08
    annular_inner_m: float = 2.0
    annular_outer_m: float = 40.0
    peak_smooth_sigma: float = 2.5
    nms_radius_px: int = 30
    min_ridge_length_px: int = 15
    smooth_spine_window: int = 5
    min_flat_zone_size_px: int = 80
    flat_zone_slope_threshold_deg: float = 5.0
    saddle_k_min_threshold: float = 2e-4
    saddle_confidence_threshold: float = 0.5
    exclude_below_reference: bool = True
    elevation_reference_m: float = 1.5
    border_margin_px: int = 10
    prominence_search_radius_m: float = 50.0
    feature_connection_tolerance_px: float = 10.0
    visibility_max_range_m: float = 500.0
    visibility_epsilon: float = 0.1
    observer_height_m: float = 1.7
    target_height_m: float = 0.0
    ridge_visibility_scale: float = 0.8
    stream_accumulation_threshold_px: int = 120
    feature_snap_distance_px: float = 20.0
    snap_method: str = "nearest"
    connection_radius_m: float = 40.0
    vehicle_climb_angle: float = 25.0
    cliff_threshold_degrees: float = 45.0
    traversability_cost_function: str = "tobler"
    traversability_unit: str = "time"
    cost_curvature_weight: float = 0.3
    cost_roughness_weight: float = 0.2
    connectivity_max_cost: float = 1000.0
    connectivity_heuristic_buffer: float = 1.5
    watershed_min_area_m2: float = 750.0
    stream_min_size_px: int = 10

    @property
    def prominence_radius_px(self) -> int:
        return int(self.prominence_search_radius_m / self.horizontal_scale)

    @property
    def connection_radius_px(self) -> float:
        return self.connection_radius_m / self.horizontal_scale


#: Vehicles, the steepest slope each takes in degrees and the deepest water in metres.
VEHICLES = {
    "infantry": (45.0, 0.5),
    "light_wheeled": (25.0, 0.3),
    "heavy_wheeled": (20.0, 0.5),
    "tracked": (35.0, 1.0),
    "tank": (30.0, 1.5),
}


def can_traverse(vehicle: str, slope_deg: float) -> bool:
    return slope_deg <= VEHICLES[vehicle][0]
