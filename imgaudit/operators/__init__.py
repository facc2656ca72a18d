"""Table jobs: sampling, exclusion, near duplicates, metrics, probes, resampling, images."""
