"""layerlog.plans"""
