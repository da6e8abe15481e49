"""Result-set analytics: plans over tables of measured runs."""
